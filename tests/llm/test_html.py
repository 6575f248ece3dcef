"""Main text of pages of invented hosts, each with its own layout, against the texts that they were made of."""

from __future__ import annotations

import html
import random

import pytest

from itembank.llm import html_text as H

LAYOUTS = [
    ('<body><nav><ul><li><a href="/a">Home</a><li><a href="/b">{nav}</a></ul></nav><div class="ad">{ad}</div><article><h1>{h}</h1>{body}</article><footer>&copy; {ad}</footer></body>', 0),
    ('<body><div id="top-menu"><a href=x>{nav}</a></div><div class="wrap"><div class="post-{i}"><h2>{h}</h2>{body}<form><input name=q>{ad}</form></div><div class="sidebar"><p>{ad}</p></div></div><section class="comments"><p>{ad}</p></section></body>', 1),
    ('<body><header><h1>Site</h1></header><main>{cookie}<h1>{h}</h1>{body}<aside>{ad}</aside></main><script>var x = "<p>no</p>";</script></body>', 2),
]
COOKIE = '<div class="bar-x"><p>We value your privacy, accept all.</p></div>'


def pages():
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh&<é") for _ in range(rng.randint(1, 7))) for _ in range(n))
    rows = []
    for i in range(90):
        layout, host = LAYOUTS[i % 3]
        h, blocks = text(5), [text(rng.randint(20, 40)) for _ in range(rng.randint(2, 6))]
        body = "".join(f"<p>{html.escape(b).replace(' ', ' <b>', 1)}</b>" + ("</p>" if k % 2 else "") for k, b in enumerate(blocks))
        rows.append((i, f"https://h{host}.example/{i}", layout.format(nav=text(1).replace("<", ""), ad=html.escape(text(4)), h=html.escape(h), body=body, i=i, cookie=COOKIE), "\n".join([h, *blocks])))
    return rows


def test_texts_of_three_layouts(spark):
    rows = pages()
    df = spark.createDataFrame([r[:3] + ("clash",) * 3 for r in rows], "page_id long, url string, html string, host string, text string, rules string")
    got = {r["page_id"]: r for r in H.query(df).collect()}
    for i, url, _, want in rows:
        assert got[i]["text"] == " ".join(want.split(" ")) and got[i]["n_chars"] == len(want) and got[i]["url"] == url


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "https://a.example/", "just text &amp; more"), (None, "https://a.example/", "<p>one<p>two\n\n three"), (5, "https://a.example/", "<div>" * 900 + "deep"), (5, "https://a.example/", "<p>r</p>"), (6, "https://b.example", "<p>" + "long " * 60_000), (7, "https://c.example", "<a href='x>broken <p>t</p>")]
    got = [(r["page_id"], r["text"]) for r in H.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    assert {(1, ""), (2, ""), (3, "just text & more"), (None, "one\ntwo three"), (5, "deep"), (5, "r")} <= set(got)
    assert ("long " * 60_000).strip() in dict(got)[6]
    assert H.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_align_optional_and_repeated_parts():
    a, b = H.wrapper_of(H.parse("<div><p>x</p><p>y</p><hr></div>")), H.wrapper_of(H.parse("<div><h2>t</h2><p>z</p></div>"))
    inner = H._merge_into(a, b)["i"][0]["i"]
    assert [(x["k"], x["o"], x["r"]) for x in inner] == [("h2", True, False), ("p", False, True), ("hr", True, False)]
    group = H.wrapper_of(H.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))["i"][0]["i"]
    assert [(x["k"], x["r"]) for x in group] == [("(dt dd)", True)]


def test_same_text_on_every_page_is_a_notice():
    rules = None
    for i in range(8):
        w = H.wrapper_of(H.parse(f"<main><div class=x><p>Same words here</p></div><p>{'own ' * 30}{i}</p></main>"))
        rules = H._merge_into(rules, w) if rules else w
    assert H.main_text("<main><div class=x><p>Same words here</p></div><p>mine</p></main>", H.rules_of(rules)) == "mine"


def merged(pages):
    rules = None
    for page in pages:
        w = H.wrapper_of(H.parse(page))
        rules = H._merge_into(rules, w) if rules else w
    return H.rules_of(rules)


def test_one_constant_or_linked_element_leaves_its_siblings():
    own = lambda i: "".join(f"<p>{'own ' * 30}{i} {k}</p>" for k in range(3))
    thanks = [f"<article><h1>t{i}</h1>{own(i)}<h2>End</h2><p>Thanks for reading</p></article>" for i in range(8)]
    assert H.main_text(thanks[2], merged(thanks)).split("\n") == ["t2", *[f"{'own ' * 30}2 {k}" for k in range(3)], "End", "Thanks for reading"]
    lists = [f"<article>{own(i)}<ul><li>real {i}<li>list {'word ' * 8}</ul><h2>More</h2><ul><li><a href=x>Link {i}</a><li><a href=y>Link two</a></ul></article>" for i in range(8)]
    assert H.main_text(lists[3], merged(lists)).split("\n")[3:] == ["real 3", "list" + " word" * 8, "More"]
    divs = [f"<article><div>{'own ' * 30}{i}</div><hr><div>All rights reserved</div></article>" for i in range(8)]
    assert H.main_text(divs[1], merged(divs)) == ("own " * 30) + "1"
    heads = [f"<main><header>Site {i}</header><p>{'own ' * 30}</p><header><h1>Title {i}</h1></header></main>" for i in range(8)]
    assert H.main_text(heads[4], merged(heads)).split("\n")[1:] == ["Title 4"]
    hidden = [f"<main><div hidden>secret {i}</div><p>{'own ' * 30}</p><div>text {i} {'more ' * 9}</div></main>" for i in range(8)]
    assert H.main_text(hidden[5], merged(hidden)).split("\n")[1:] == ["text 5" + " more" * 9]


def own(i, n=4):
    return "".join(f"<p>{'own ' * 30}{i} {k}</p>" for k in range(n))


def words_of(i, n=4):
    return [f"{'own ' * 30}{i} {k}" for k in range(n)]


def test_deep_and_wide_pages(spark):
    deep = "<article>" + "<div>" * 20_000 + "deep" + "</div>x" * 20_000
    wide = "<body><article>" + "".join(f"<p>one {k}</p><h2>two {k}</h2>" for k in range(15_000)) + "</article></body>"
    many = ["<article>" + "".join(f"<div class=c{chr(97 + k % 26)}{'x' * (k * (i + 2) % 97)}><p>t {k}</p></div>" for k in range(6000)) + "</article>" for i in range(2)]
    rows = [(1, "https://a.example", deep), (2, "https://a.example", "<div><p>x</p></div>"), (3, "https://b.example", wide), (4, "https://b.example", wide), (5, "https://c.example", many[0]), (6, "https://c.example", many[1])]
    got = {r["page_id"]: r["text"] for r in H.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].startswith("deep\nx") and got[1].count("x") == 20_000 and got[3].count("\n") == 29_999 == got[4].count("\n")
    assert got[5].split("\n") == [f"t {k}" for k in range(6000)] == got[6].split("\n")


def test_wrappers_outlive_their_text_form():
    w = H.wrapper_of(H.parse("<div>" * 3000 + "<p>a<p>b" + "</div>" * 3000))
    assert H.dumps(H.loads(H.dumps(w))) == H.dumps(w)


def test_names_of_page_builders_do_not_empty_a_page():
    page = lambda i: f'<body><nav><a href=x>Home</a></nav><div class="elementor-widget"><div class="elementor-widget-container">{own(i)}</div></div></body>'
    assert H.main_text(page(1), None).split("\n") == words_of(1) == H.main_text(page(1), merged([page(i) for i in range(8)])).split("\n")
    sides = f'<div class="content has-sidebar"><article>{own(2)}</article><div class=sidebar>menu</div></div>'
    assert H.main_text(sides, None).split("\n") == words_of(2)


def test_a_form_around_the_article():
    page = f"<form id=x><input name=q><button>Go</button><article>{own(3)}</article></form>"
    assert H.main_text(page, None).split("\n") == words_of(3)
    plain = f"<body><form id=aspnet><div>{own(4)}</div></form><form><p>Your mail</p></form></body>"
    assert H.main_text(plain, None).split("\n") == words_of(4)


def test_the_hosts_pages_overrule_vague_names_and_find_unnamed_notices():
    page = lambda i: f"<article>{own(i)}<div class=promo>{'story ' * 9}{i}</div><div class=zz>Buy now and save</div></article>"
    alone, by_host = H.main_text(page(5), None).split("\n"), H.main_text(page(5), merged([page(i) for i in range(9)])).split("\n")
    assert alone == [*words_of(5), "Buy now and save"]
    assert by_host == [*words_of(5), "story " * 9 + "5"]


def test_long_class_lists_stay_apart():
    same = "a" * 90
    page = lambda i: f'<article><div class="{same} one">Same words here</div><div class="{same} two">{"text " * 20}{i}</div></article>'
    assert H.main_text(page(1), merged([page(i) for i in range(8)])) == "text " * 20 + "1"


def test_a_headline_beside_the_body():
    page = lambda i: f"<body><div class=top><h1>Title {i}</h1></div><div class=rest>{own(i)}</div></body>"
    assert H.main_text(page(2), merged([page(i) for i in range(8)])).split("\n") == ["Title 2", *words_of(2)]


def test_groups_of_any_length_repeat():
    w = H.wrapper_of(H.parse("<div>" + "<h2>a</h2><p>b</p><ul><li>c</ul><table></table><pre>d</pre><hr>" * 3 + "</div>"))
    assert [(x["k"], x["r"], len(x["i"])) for x in w["i"][0]["i"]] == [("(h2 p ul table pre hr)", True, 6)]


def on_host(extra, i=0, pages=8):
    """The text of page i of a host whose articles hold extra(page) between two paragraphs of their own."""
    page = lambda k: f'<html><body><nav><a href="/a">Home</a> <a href="/b">News</a></nav><article>{own(k)}{extra(k)}{own(k + 50)}</article><footer>Copyright</footer></body></html>'
    return H.main_text(page(i), merged([page(k) for k in range(pages)]))


@pytest.mark.parametrize("name", ["ad-hoc-study", "hidden-gems", "menu-of-the-day", "banner-title", "comment-free-analysis", "signup-numbers", "cookie-recipe", "pager-history"])
def test_names_that_only_hold_a_plain_word_drop_no_text(name):
    assert "findings of page 3" in on_host(lambda k: f'<div class="{name}"><p>{"findings " * 9}</p><p>findings of page {k} and more</p></div>', 3)


@pytest.mark.parametrize("name", ["ad", "ad-banner", "ads-slot-17", "site-nav", "comments-list", "newsletter-signup", "sidebar-left", "cookie-consent-bar", "ad ad-300x250"])
def test_plain_names_still_drop(name):
    assert "findings" not in on_host(lambda k: f'<div class="{name}"><p>findings of page {k} and more</p></div>', 3)


@pytest.mark.parametrize("advert", ['<span class="ad">BUY</span>', '<a class="ads" href="x">BUY</a>', "<span hidden>BUY</span>", '<span style="color:red; display : none">BUY <b>it</b> <span>BUY</span> now</span>', '<b class="ad-label sponsored">BUY <br> now</b>'])
def test_unseen_inline_elements_leave_the_text_around_them_whole(advert):
    assert "before after words" in on_host(lambda k: f"<p>before {advert} after words</p>").split("\n")


def test_inline_names_that_are_no_adverts_stay():
    assert "a comment hid word" in on_host(lambda k: '<p>a <span class="comment">comment</span> <i class="ad-hoc">hid</i> <span aria-hidden="false">word</span></p>')


def test_unseen_blocks_go():
    assert "BUY" not in on_host(lambda k: '<div style="Display: none"><p>BUY</p></div><div style="visibility:hidden">BUY</div>')


def test_a_list_of_links_that_differ_from_page_to_page_is_text_and_a_menu_repeats():
    links = lambda k: f'<h2>References</h2><ol><li><a href=a>Source {k} one</a><li><a href=b>Source {k} two</a></ol><ul><li><a href=x>Link {k}</a><li><a href=y>All topics</a></ul>'
    assert on_host(links, 3).split("\n")[4:7] == ["References", "Source 3 one", "Source 3 two"] and "topics" not in on_host(links, 3)
    other = lambda k: f'<section><h2>Sources</h2><ul><li><a href=a>Entry {k} of the list</a><li><a href=b>Entry {k} as well</a></ul></section>'
    assert on_host(other, 5).split("\n")[4:7] == ["Sources", "Entry 5 of the list", "Entry 5 as well"]


def test_shared_texts_of_wide_pages_are_gathered_in_linear_time():
    page = "<ul>" + "".join(f"<li><a href=x>link {k}</a>" for k in range(30_000)) + "</ul>"
    w = H.loads(H.dumps(H.wrapper_of(H.parse(page))))
    assert len(w["i"][0]["i"][0]["i"][0]["s"]) == 30_000
    assert H._merge_into(w, H.wrapper_of(H.parse("<ul><li><a href=x>link 7</a><li>other</ul>")))["i"][0]["i"][0]["i"][0]["s"] == {H._text_hash("link 7")[0]}


def made_anew(i, rng):
    name = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    body = "".join(f'<div class="css-{name()}"><p>{words}</p></div>' for words in words_of(i))
    return f'<body><div class="css-{name()}"><div class="css-{name()}">{body}</div></div><div class="css-{name()}"><ul class="css-{name()}"><li><a href=x>About us</a></ul></div></body>'


def of_one_task(pages, halves=None):
    """The wrapper that a task, or two, hands on for pages of one host."""
    import pyarrow as pa

    parts = [pages] if halves is None else [pages[:halves], pages[halves:]]
    out = []
    for part in parts:
        batches = iter([pa.RecordBatch.from_arrays([pa.array(["h"] * len(part)), pa.array(part)], names=["host", "html"])])
        out += [row["wrapper"] for batch in H._partial(batches) for row in batch.to_pylist()]
    return out[0] if len(out) == 1 else H.dumps(H._merge_into(*map(H.loads, out)))


def test_class_names_made_anew_for_every_page_do_not_let_a_wrapper_grow():
    rng = random.Random(3)
    pages = [made_anew(i, rng) for i in range(300)]
    sizes = [len(of_one_task(pages[:n])) for n in (100, 300)]
    assert sizes[1] < 1.2 * sizes[0] < 3000
    for wrapper in (of_one_task(pages), of_one_task(pages, 70)):
        rules = H.rules_of(H.loads(wrapper))
        assert all(H.main_text(pages[i], rules).split("\n") == words_of(i) for i in (0, 50, 299))


def test_a_layout_that_a_host_takes_up_later_is_not_rare():
    old = [f'<body><div class="top">Menu of old</div><div class="layout-one">{own(i)}</div></body>' for i in range(100)]
    new = [f'<body><div class="layout-two">{own(i)}<div class="related">{"story " * 9}{i}</div></div></body>' for i in range(60)]
    rules = H.rules_of(H.loads(of_one_task(old + new)))
    assert H.main_text(new[7], rules).split("\n") == [*words_of(7), "story " * 9 + "7"]
    assert H.main_text(old[7], rules).split("\n")[-4:] == words_of(7)
