"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of each host."""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import releasing, small_enough, written

#: Hosts whose partial wrappers a task holds before it hands them on.
HELD_HOSTS = 2000
#: Partial wrappers of a host are merged in so many groups first.
SALTS = 256
#: At most so many hosts' rules, and bytes of them, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: A container whose text is the same on so many pages, and on half of the host's, is a notice rather than text, unless this share of the text would go.
SAME_PAGES, SAME_SHARE = 5, 0.2
#: Share of the text that a container must hold for the search to go down into it; share of link text from which a slot is a menu.
DOWN, LINKS = 0.7, 0.6
#: Shares of a page's text from which a named main part, and a form or a vaguely named element, can't be boilerplate.
MAIN_SHARE, MOST_SHARE = 0.25, 0.5
#: Lists of items are aligned cell by cell up to so many cells; longer ones between the items that both have once.
ALIGN_CELLS = 40_000
#: An element that at most one page in RARE_ONE has, and fewer than SAME_PAGES in all, or one page in RARE_ALL, is known by its tag alone.
RARE_ONE, RARE_ALL = 32, 256
#: Longer element keys are cut and given a digest of the whole.
KEY_CHARS = 80

#: Elements and class words.
RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select"
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROP_TAGS = set("head title nav footer aside form menu dialog button fieldset".split())
#: Names that say what an element is.
DROP_WORDS = set("nav navbar navigation menu menubar sidebar footer masthead banner ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal newsletter signup login comment comments reply replies disqus breadcrumb breadcrumbs pagination pager hidden".split())
#: Words that say where or what kind of part something is: beside one of these, or alone, a name above counts in full; beside any other word (ad-hoc-study, menu-of-the-day) as a vague one.
PLACE_WORDS = set("site page global main top bottom left right upper lower inner outer primary secondary sub mobile desktop sticky fixed floating visually is has js list item items box block area bar wrap wrapper wrapping container content section inline slot unit space row col column grid link links button buttons btn form field group panel head header body widget module component post article entry user thread tree count text label icon toggle trail native xs sm md lg xl".split())
#: Names of inline elements whose text is no part of the running text.
INLINE_DROP = set("ad ads advert adverts advertisement advertising sponsor sponsored hidden".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Names that are often given to parts of a text as well: these only count where the host's pages don't tell.
VAGUE_WORDS = set("aside promo promotion notice notices notification alert overlay subscribe subscription share sharing social related recommended recommendations respond search toolbar widget copyright legal disclaimer skip".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Parts of running text: a constant one is text of the article, not a notice.
PROSE = set("p h1 h2 h3 h4 h5 h6 hgroup li dt dd tr td th thead tbody tfoot caption figcaption pre blockquote summary".split())
TEXT_WORDS = set("article content post entry story main body text maincontent articlebody postbody".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S | re.I)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
DIGITS, WORDS = re.compile(r"\d+"), re.compile(r"[a-z]+")


class Node:
    """A block element: its key, whether its name marks it as boilerplate (2, or 1 for a vague name), and texts and children in order; links: characters in links."""

    __slots__ = ("tag", "key", "drop", "main", "items", "links")

    def __init__(self, tag: str, key: str, drop: int, main: bool) -> None:
        self.tag, self.key, self.drop, self.main, self.items, self.links = tag, key, drop, main, [], 0


_kinds: dict[tuple[str, str], tuple[str, int, bool]] = {}


def _by_name(value: str) -> tuple[int, bool]:
    """What the names of a class or id say: boilerplate (2, 1 for vague names and for plain ones beside other words), and main text."""
    drop, found = 0, set()
    for name in value.split():
        parts = set(WORDS.findall(DIGITS.sub(" ", name)))
        found |= parts
        if parts & DROP_WORDS:
            drop = max(drop, 2 if parts <= DROP_WORDS | VAGUE_WORDS | PLACE_WORDS else 1)
    if found & VAGUE_WORDS and not found & TEXT_WORDS:
        drop = max(drop, 1)
    return drop, bool(found & TEXT_WORDS)


def _unseen(tag: str, attrs: str) -> bool:
    """Whether an inline element is an advert by name, or hidden."""
    for m in ATTR.finditer(attrs):
        what, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if what == "hidden" and value != "false" or what == "style" and UNSEEN.search(value):
            return True
        if what in ("class", "id") and any(parts & INLINE_DROP and parts <= DROP_WORDS | PLACE_WORDS for name in value.split() if (parts := set(WORDS.findall(DIGITS.sub(" ", name))))):
            return True
    return False


def _kind(tag: str, attrs: str) -> tuple[str, int, bool]:
    """Key, boilerplate by name, main text by name of an element."""
    known = _kinds.get((tag, attrs))
    if known is None:
        name, drop, main = [], 2 if tag in DROP_TAGS else 0, tag in ("article", "main")
        for m in ATTR.finditer(attrs):
            what, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if what == "style":
                drop = 2 if UNSEEN.search(value) else drop
            elif what == "role":
                drop, main = 2 if value in DROP_ROLES else drop, main or value == "main"
            elif what in ("hidden", "aria-hidden"):
                drop = 2 if (value != "false" if what == "hidden" else value == "true") else drop
            else:
                name.append(DIGITS.sub("0", value))
                by_name, text = _by_name(value)
                drop, main = max(drop, by_name), main or text
        key = ".".join([tag, *name])
        if len(key) > KEY_CHARS:
            key = key[:KEY_CHARS] + "~" + hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        known = key, drop, main
        if len(_kinds) > 50_000:
            _kinds.clear()
        _kinds[tag, attrs] = known
    return known


def parse(page: str) -> Node:
    """The page's tree of block elements. Unclosed and stray tags are mended as browsers do for paragraphs, lists and tables."""
    root = Node("", "", 0, False)
    stack, link = [root], 0
    for m in TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                top = stack[-1]
                top.items.append(token)
                if link:
                    top.links += len(token)
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            if tag == "a":
                link = 0
            if tag in INLINE:
                if stack[-1].tag == tag:  # only unseen ones, and what is inside them, are on the stack
                    stack.pop()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    link = 0
                    break
            continue
        if tag in INLINE:
            attrs = m[4] or m[7] or ""
            if tag not in VOID and (stack[-1].tag in INLINE or attrs and _unseen(tag, attrs)):
                stack.append(Node(tag, tag, 2, False))  # beside the tree: its text goes, and the text around it stays one
            elif tag == "a":
                link = 1
            elif tag == "br":
                stack[-1].items.append(" ")
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in SELF_CLOSING:
            shut, scope = SELF_CLOSING[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in shut:
                    del stack[i:]
                    break
        node = Node(tag, *_kind(tag, m[4] or m[7] or ""))
        if node.drop and tag in ("html", "body", "article", "main"):  # a theme's class on the whole page doesn't drop it
            node.drop = 2 if tag == "article" and {"comment", "comments", "reply"} & set(WORDS.findall(node.key)) else 0
        stack[-1].items.append(node)
        if tag not in VOID:
            stack.append(node)
    _guarded(root)
    return root


def _preorder(root: Node) -> list[Node]:
    """The element and all below it, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.items) if not isinstance(x, str)]
    return out


def _runs(node: Node) -> Iterator[str | Node]:
    """The node's texts, white space as one space, and children in order."""
    texts: list[str] = []
    for x in [*node.items, None]:
        if isinstance(x, str):
            texts.append(x)
            continue
        if text := " ".join("".join(texts).split()):
            yield text
        texts.clear()
        if x is not None:
            yield x


def _guarded(root: Node) -> None:
    """What holds the page's main part isn't boilerplate, whatever its name; nor is a form or a vaguely named element that holds most of the text. Boilerplate gets keys of its own."""
    nodes = _preorder(root)
    mass: dict[Node, int] = {}
    inside: dict[Node, int] = {}  # the largest named main part
    for node in reversed(nodes):
        c, best = -node.links, 0
        for x in _runs(node):
            if isinstance(x, str):
                c += len(x)
            else:
                c += 0 if x.drop == 2 else mass[x]
                best = max(best, inside[x])
        mass[node], inside[node] = c, max(best, c if node.main and node.drop < 2 else 0)
    total = max(1, sum(len(x) for node in nodes for x in _runs(node) if isinstance(x, str)) - sum(node.links for node in nodes))
    for node in nodes:
        if node.drop and (inside[node] >= MAIN_SHARE * total or (node.drop == 1 or node.tag == "form") and mass[node] >= MOST_SHARE * total):
            node.drop = 0
        node.key += ("", "?", "!")[node.drop]


# A wrapper is a dict: k its key ("#" a text slot, "()" a repeated group, "tag.*" any element of the tag that is rare there), n pages,
# c characters, l those in links, t the text if it is always the same, s the texts (hashes) of a slot with links that all pages have, d and m boilerplate
# and main text by name, o optional, r repeated, i its items in order.


def _wild(key: str, main: bool, drop: int) -> str:
    """The key by tag alone: names are left out, what they say of the element stays. Text slots and elements without a name keep theirs."""
    tag, dot, _ = key.partition(".")
    return f"{tag}.*{'m' if main else ''}{('', '?', '!')[drop]}" if dot and key[0] != "(" else key


def _is_wild(key: str) -> bool:
    return key.partition(".")[2].rstrip("?!") in ("*", "*m") and key[0] != "("


def _merge_into(a: dict[str, Any], b: dict[str, Any], pages: bool = True) -> dict[str, Any]:
    """One wrapper for the pages of both (pages), or for two of the same page's elements."""
    _merge_all([(a, b, pages)])
    if pages and a["n"] >= RARE_ONE:
        _close_gaps(a)
    return a


def _merge_all(work: list[Any]) -> None:
    """The first of each pair becomes the wrapper of both."""
    while work:
        x, y, pages = work.pop()
        x["n"] = x["n"] + y["n"] if pages else max(x["n"], y["n"])
        if pages:
            x["s"] &= y["s"]
        else:
            x["s"] |= y["s"]
        x["c"] += y["c"]
        x["l"] += y["l"]
        x["o"] |= y["o"]
        x["r"] |= y["r"]
        if x["t"] != y["t"]:
            x["t"] = None
        x["i"] = _align(x["i"], y["i"], pages, work)


def _close_gaps(w: dict[str, Any]) -> None:
    """Rare items between two that aren't, known by their tags alone, become one optional item a tag, so that a wrapper's size doesn't follow
    the pages where names are made anew for each of them."""
    stack = [(w, w["n"])]
    while stack:
        x, pages = stack.pop()
        out: list[dict[str, Any]] = []
        gap: dict[str, dict[str, Any]] = {}
        for y in x["i"]:
            n = max(z["n"] for z in y["i"]) if y["k"][0] == "(" else y["n"]
            if not (n * RARE_ALL <= pages or n < SAME_PAGES and n * RARE_ONE <= pages or _is_wild(y["k"])):
                out += gap.values()
                gap = {}
                out.append(y)
                continue
            for z in y["i"] if y["k"][0] == "(" else [y]:
                key = _wild(z["k"], z["m"], z["d"])
                if key in gap:
                    n = gap[key]["n"] + z["n"]
                    _merge_all([(gap[key], z, True)])
                    gap[key] |= {"n": min(n, pages), "r": gap[key]["r"] or n > pages}
                else:
                    gap[key] = z | {"k": key, "o": True, "r": z["r"] or y["r"]}
        x["i"] = [*out, *gap.values()]
        stack += [(y, pages if y["k"][:1] == "(" else max(1, y["n"])) for y in x["i"] if y["i"]]


def _pairs(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    """Places of equal keys in a common subsequence: the longest one, or that of the keys which both have once with the longest ones between them."""
    lo = 0
    while lo < min(len(ka), len(kb)) and ka[lo] == kb[lo]:
        lo += 1
    hi = 0
    while hi < min(len(ka), len(kb)) - lo and ka[-1 - hi] == kb[-1 - hi]:
        hi += 1
    n, m = len(ka) - lo - hi, len(kb) - lo - hi
    head, tail = [(i, i) for i in range(lo)], [(len(ka) - hi + i, len(kb) - hi + i) for i in range(hi)]
    if not n or not m:
        return head + tail
    if n * m <= ALIGN_CELLS:
        best = np.zeros((n + 1, m + 1), dtype=np.int32)
        same = np.array(ka[lo : lo + n], dtype=object)[:, None] == np.array(kb[lo : lo + m], dtype=object)[None, :]
        for i in range(n - 1, -1, -1):  # along a row, a cell is the largest of what lies below it and what matches from it on
            best[i, :m] = np.maximum(best[i + 1, :m], np.where(same[i], best[i + 1, 1:] + 1, 0))
            best[i] = np.maximum.accumulate(best[i, ::-1])[::-1]
        out, i, j = [], 0, 0
        while i < n and j < m:
            if same[i, j]:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1, j] >= best[i, j + 1]:
                i += 1
            else:
                j += 1
        return head + out + tail
    a, b = Counter(ka[lo : lo + n]), Counter(kb[lo : lo + m])
    at = {k: lo + j for j, k in enumerate(kb[lo : lo + m]) if b[k] == 1 and a[k] == 1}
    ends: list[int] = []
    chain: list[tuple[int, int, int]] = []  # place in a, place in b, the one before
    last: list[int] = []
    for i in range(lo, lo + n):
        if ka[i] in at:
            k = bisect_left(ends, at[ka[i]])
            chain.append((i, at[ka[i]], last[k - 1] if k else -1))
            ends[k : k + 1], last[k : k + 1] = [at[ka[i]]], [len(chain) - 1]
    anchors, k = [], last[-1] if last else -1
    while k >= 0:
        anchors.append(chain[k][:2])
        k = chain[k][2]
    out, i, j = [], lo, lo
    for x, y in [*anchors[::-1], (lo + n, lo + m)]:
        if x > i and y > j and (x - i) * (y - j) <= ALIGN_CELLS:
            out += [(i + p, j + q) for p, q in _pairs(ka[i:x], kb[j:y])]
        if x < lo + n:
            out.append((x, y))
        i, j = x + 1, y + 1
    return head + out + tail


def _align(a: list[dict[str, Any]], b: list[dict[str, Any]], pages: bool, work: list[Any]) -> list[dict[str, Any]]:
    """The items of two token streams as one: equal keys of a common subsequence are to be merged (work), mismatches become optional."""
    out, i, j = [], 0, 0
    for x, y in [*_pairs([x["k"] for x in a], [y["k"] for y in b]), (len(a), len(b))]:
        out += [z | {"o": True} for z in a[i:x]] + [z | {"o": True} for z in b[j:y]]
        if x < len(a):
            work.append((a[x], b[y], pages))
            out.append(a[x])
        i, j = x + 1, y + 1
    return _folded(out, pages, work) if len(out) > len(a) or len(out) > len(b) else out


def _folded(items: list[dict[str, Any]], pages: bool, work: list[Any]) -> list[dict[str, Any]]:
    """With runs of equal items, and then of equal groups of items of any length, as one repeated item; their parts are to be merged (work)."""
    for groups in (False, True):
        out: list[dict[str, Any]] = []
        keys, i = [x["k"] for x in items], 0
        again = {}  # the next place with the same key
        follows = [len(keys)] * len(keys)
        for k in range(len(keys) - 1, -1, -1):
            follows[k] = again.get(keys[k], len(keys))
            again[keys[k]] = k
        while i < len(items):
            p, times = follows[i] - i if groups else 1, 1
            while i + (times + 1) * p <= len(items) and keys[i + times * p : i + (times + 1) * p] == keys[i : i + p]:
                times += 1
            if times == 1:
                out.append(items[i])
                i += 1
                continue
            group = items[i : i + p]
            for t in range(1, times):
                work += [(x, y, pages) for x, y in zip(group, items[i + t * p : i + (t + 1) * p])]
            node = group[0] if p == 1 else {"k": "(" + " ".join(keys[i : i + p]) + ")", "n": group[0]["n"], "c": 0, "l": 0, "t": None, "s": set(), "d": 0, "m": False, "o": False, "r": True, "i": group}
            node["r"] = True
            out.append(node)
            i += times * p
        items = out
    return items


def _shown(text: str) -> str:
    """A slot's text as wrappers hold it."""
    return text if len(text) < 300 else text[:280] + str(zlib.crc32(text.encode("utf-8", "surrogatepass")))


def wrapper_of(root: Node) -> dict[str, Any]:
    """The wrapper that one page alone gives."""
    made: dict[Node, dict[str, Any]] = {}
    for node in reversed(_preorder(root)):
        items = [{"k": "#", "n": 1, "c": len(x), "l": 0, "t": _shown(x), "s": {_text_hash(_shown(x))[0]} if node.links else set(), "d": 0, "m": False, "o": False, "r": False, "i": []} if isinstance(x, str) else made.pop(x) for x in _runs(node)]
        work: list[Any] = []
        items = _folded(items, False, work)
        for x, y, _ in work:
            _merge_into(x, y, False)
        made[node] = {"k": node.key, "n": 1, "c": 0, "l": node.links, "t": None, "s": set(), "d": node.drop, "m": node.main, "o": False, "r": False, "i": items}
    return made[root]


FIELDS = ("k", "n", "c", "l", "t", "s", "d", "m", "o", "r")


def dumps(w: dict[str, Any]) -> str:
    """The wrapper as JSON without nesting: each item in preorder, with the number of its items."""
    out, stack = [], [w]
    while stack:
        x = stack.pop()
        out.append([*(sorted(x[f]) if f == "s" else x[f] for f in FIELDS), len(x["i"])])
        stack += reversed(x["i"])
    return json.dumps(out)


def loads(text: str) -> dict[str, Any]:
    root: dict[str, Any] = {"i": []}
    open_ = [(root, 1)]
    for row in json.loads(text):
        while len(open_[-1][0]["i"]) == open_[-1][1]:
            open_.pop()
        x = dict(zip(FIELDS, row)) | {"i": []}
        x["s"] = set(x["s"])
        open_[-1][0]["i"].append(x)
        open_.append((x, row[-1]))
    return root["i"][0]


#: A list of texts as a polynomial of their hashes, so that lists are joined in one step: value and number of texts.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
Texts = tuple[int, int]


def _text_hash(text: str) -> Texts:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little"), 1


def _joined(a: Texts, b: Texts) -> Texts:
    return (a[0] * pow(_BASE, b[1], _PRIME) + b[0]) % _PRIME, a[1] + b[1]


@lru_cache(1 << 16)
def _step(path: int, key: str) -> int:
    """The number of a path of element keys that goes on by one."""
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=7, salt=path.to_bytes(8, "little")).digest(), "little")


def _weigh(w: dict[str, Any]) -> list[tuple[dict[str, Any], int, int]]:
    """Items, parents first, with their paths (groups are looked through) and their parents' places.

    Each item gets C and L, its characters of text and link text outside boilerplate; T, its texts where they are the same on all
    pages that have it; S, whether one with links is on all pages that have its slot; g, whether it goes: by its name, or by a vague name that the host's pages don't refute with text of its own.
    """
    order: list[tuple[dict[str, Any], int, int]] = []
    stack = [(w, 0, -1)]
    while stack:
        x, path, parent = stack.pop()
        own = path if x is w or x["k"][:1] == "(" else _step(path, x["k"])
        order.append((x, own, parent))
        stack += [(y, own, len(order) - 1) for y in reversed(x["i"])]
    for x, _, _ in reversed(order):
        x["C"], x["L"], texts = x["c"], x["l"], (0, 0)
        if x["k"] == "#":
            x["T"], x["S"] = None if x["t"] is None else _text_hash(x["t"]), bool(x["s"])
        else:
            x["S"] = any(y["S"] for y in x["i"] if not y["g"])
            for y in x["i"]:
                if not y["g"]:
                    x["C"], x["L"] = x["C"] + y["C"], x["L"] + y["L"]
                    if y["C"]:
                        texts = None if texts is None or y["o"] or y["r"] or y["T"] is None else _joined(texts, y["T"])
            x["T"] = texts
        told = not _is_wild(x["k"]) and x["n"] >= SAME_PAGES and x["C"] and x["T"] is None and x["L"] <= LINKS * x["C"]
        x["g"] = x["d"] == 2 or x["d"] == 1 and not told
    return order


def rules_of(w: dict[str, Any]) -> dict[str, Any]:
    """Numbers of paths: root, that of the main text; below it, menus and headers: paths of which those elements go that are menus, or
    headers without a title, themselves; same: paths and the notices' texts; kept: vaguely named elements that hold texts of their own;
    gaps: paths below which elements that aren't known are taken by their tag alone.
    Siblings share paths, so no path alone drops anything."""
    order = _weigh(w)
    total, pages = max(1, w["C"]), max(1, w["n"])
    gone = [False] * len(order)  # the item or one above it goes
    depth = [0] * len(order)
    titled = [False] * len(order)
    for k, (x, _, parent) in enumerate(order):
        if parent >= 0:
            gone[k] = gone[parent] or x["g"]
            depth[k] = depth[parent] + 1
    for k in range(len(order) - 1, 0, -1):
        if titled[k] or order[k][0]["k"].split(".")[0] == "h1":
            titled[order[k][2]] = True
    tag = [x["k"].split(".")[0].rstrip("?!") for x, _, _ in order]
    named = [(0 if tag[k] == "article" else 1 if tag[k] == "main" else 2, depth[k], -x["C"], k) for k, (x, _, _) in enumerate(order) if x["m"] and not gone[k] and x["C"] >= MAIN_SHARE * total]
    inside: list[list[int]] = [[] for _ in order]
    for k, (x, _, parent) in enumerate(order):
        if parent >= 0:
            above = parent
            while order[above][0]["k"][:1] == "(":
                above = order[above][2]
            if x["k"] != "#" and x["k"][:1] != "(":
                inside[above].append(k)
    at = 0
    if named:
        at = min(named)[3]
    else:
        while below := [k for k in inside[at] if not gone[k]]:
            most = max(below, key=lambda k: order[k][0]["C"])
            title = any((titled[k] or tag[k] == "h1") and order[k][0]["T"] is None for k in below if k != most and tag[k] != "header")
            if order[most][0]["C"] < max(DOWN * max(1, order[at][0]["C"]), MOST_SHARE * total) or tag[most] in ("p", "li", "pre", "td") or title and pages >= SAME_PAGES:
                break
            at = most
    root = order[at][1]
    tops = [k for k, (x, path, _) in enumerate(order) if path == root and x["k"][:1] != "(" and x["k"] != "#" and not gone[k]] or [0]
    menus, headers, same, same_mass = set(), set(), {}, 0
    stack = [k for top in tops for k in inside[top]]
    while stack:
        k = stack.pop()
        x, path, _ = order[k]
        if x["g"]:
            continue
        if tag[k] == "header" and not titled[k]:
            headers.add(path)
        elif x["C"] and x["L"] > LINKS * x["C"] and x["r"] is False and (x["S"] or x["n"] < SAME_PAGES) and tag[k] in ("ul", "ol", "div", "section", "table"):
            menus.add(path)
        elif tag[k] not in PROSE and x["n"] >= SAME_PAGES and 2 * x["n"] >= pages and not x["r"] and x["T"] and x["T"][1]:
            same[path, x["T"][0]] = None
            same_mass += x["C"]
        else:
            stack += inside[k]
    if same_mass > SAME_SHARE * max(1, sum(order[k][0]["C"] for k in tops)):
        same = {}
    kept = {path for x, path, _ in order if x["d"] == 1 and not x["g"]}
    gaps = {order[parent][1] for x, _, parent in order if parent >= 0 and _is_wild(x["k"])}
    known = {path for x, path, parent in order if parent >= 0 and order[parent][1] in gaps and "." in x["k"] and x["k"][0] != "("}
    return {"gaps": sorted(gaps), "known": sorted(known), "root": root, "menus": sorted(menus), "headers": sorted(headers), "same": sorted(map(list, same)), "kept": sorted(kept)}


def _matched(root: Node, rule: dict[str, Any]) -> list[str]:
    """The texts in those slots of the page that the wrapper's rules call main text, as blocks in page order."""
    nodes = _preorder(root)
    kept, menus, headers = set(rule["kept"]), set(rule["menus"]), set(rule["headers"])
    gaps, known = set(rule["gaps"]), set(rule["known"])
    same: dict[int, set[int]] = {}
    for path, text in rule["same"]:
        same.setdefault(path, set()).add(text)
    path: dict[Node, int] = {root: 0}
    for node in nodes:
        for x in node.items:
            if not isinstance(x, str):
                path[x] = _step(path[node], x.key)
                if path[node] in gaps and path[x] not in known:
                    path[x] = _step(path[node], _wild(x.key, x.main, x.drop))
    goes: dict[Node, bool] = {}  # inside the main part
    sums: dict[Node, tuple[int, int, Texts]] = {}
    for node in reversed(nodes):
        c, links, texts, title = 0, node.links, (0, 0), False
        for x in _runs(node):
            if isinstance(x, str):
                c, texts = c + len(x), _joined(texts, _text_hash(_shown(x))) if same else texts
            elif not (x.drop == 2 or x.drop == 1 and path[x] not in kept):
                c, links, texts = c + sums[x][0], links + sums[x][1], _joined(texts, sums[x][2])
        for x in node.items:
            title = title or not isinstance(x, str) and x.tag == "h1"
        sums[node] = c, links, texts
        own = path[node]
        goes[node] = node.drop == 2 or node.drop == 1 and own not in kept or own in headers and not title or own in menus and links > LINKS * c or own in same and texts[0] in same[own]
    out: list[str] = []
    work: list[tuple[Iterator[str | Node], bool]] = [(_pieces(root), rule["root"] == 0)]
    dropped = lambda x: x.drop == 2 or x.drop == 1 and path[x] not in kept
    while work:
        pieces, taken = work[-1]
        for x in pieces:
            if isinstance(x, str):
                if taken:
                    out.append(x)
            elif not (goes[x] if taken else dropped(x)):
                work.append((_pieces(x), taken or path[x] == rule["root"]))
                break
        else:
            work.pop()
    return out


def _pieces(node: Node) -> Iterator[str | Node]:
    """The node's blocks of text, with character references decoded, and children in order."""
    texts: list[str] = []
    for x in [*node.items, None]:
        if isinstance(x, str):
            texts.append(x)
            continue
        if text := " ".join(html.unescape("".join(texts)).split()):
            yield text
        texts.clear()
        if x is not None:
            yield x


def main_text(page: str, rules: dict[str, Any] | None) -> str:
    """The page's blocks by its host's rules, or by those that the page alone gives where the host's lead nowhere."""
    tree = parse(page)
    out = _matched(tree, rules) if rules else []
    return "\n".join(out or _matched(tree, rules_of(wrapper_of(tree))))


@releasing
def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper for each host, of the pages that this task has seen."""
    held: dict[str, list[dict[str, Any]]] = {}  # of so many pages each that none is merged with one of fewer: what some pages in a row have isn't rare among them

    def out() -> pa.RecordBatch:
        for ws in held.values():
            while len(ws) > 1:
                _merge_into(ws[-2], ws.pop())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([dumps(ws[0]) for ws in held.values()], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ws = held.setdefault(host, [])
            ws.append(wrapper_of(parse(page)))
            while len(ws) > 1 and ws[-2]["n"] <= ws[-1]["n"]:
                _merge_into(ws[-2], ws.pop())
            if len(held) > HELD_HOSTS:
                yield out()
                held.clear()
    yield out()


def _merged(frame: pd.DataFrame, last: bool) -> pd.DataFrame:
    ws = [loads(w) for w in sorted(frame["wrapper"])]
    while len(ws) > 1:
        ws = [_merge_into(*ws[i : i + 2]) if i + 1 < len(ws) else ws[i] for i in range(0, len(ws), 2)]
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [json.dumps(rules_of(ws[0])) if last else dumps(ws[0])]})


def host_rules(pages: DataFrame) -> DataFrame:
    """host, rules. Every page takes part; each task hands on one wrapper for each host it has seen; a host's wrappers are merged in SALTS groups and then into one, so that no task merges those of all tasks."""
    partial = pages.select("host", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_partial, "host string, wrapper string").withColumn("salt", F.spark_partition_id() % SALTS)
    some = partial.groupBy("host", "salt").applyInPandas(lambda frame: _merged(frame, False), "host string, wrapper string")
    return some.groupBy("host").applyInPandas(lambda frame: _merged(frame, True), "host string, wrapper string").withColumnRenamed("wrapper", "rules")


@releasing
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules: dict[str, Any] = {}
    for batch in batches:
        names = batch.schema.names
        page, rule = batch.column(names.index("html")).to_pylist(), batch.column(names.index("rules")).to_pylist()
        out = []
        for h, r in zip(page, rule):
            if r is not None and r not in rules:
                rules[r] = json.loads(r)
            out.append(main_text(h or "", rules.get(r)))
        yield pa.RecordBatch.from_arrays([batch.column(names.index("id")), batch.column(names.index("url")), pa.array(out, pa.string())], names=["id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars.

    The pages of a host are aligned token stream by token stream into one union-free regular expression: what all have stays, what
    some lack becomes optional, runs become repeated groups, texts become slots. Slots whose text never changes, and those of links,
    are boilerplate; those with texts of their own are main text, and vague names (widget, related, promo) then don't count: they
    only decide where a host has too few pages. Plain names (nav, footer, ad, comments) mark boilerplate that changes, unless it
    holds the main part. Each page's stream is then matched with its host's wrapper and its main slots are read; of elements that
    share a path only those go that are menus or notices themselves. Pages are read twice and never shuffled, unless there are more
    hosts than BROADCAST_ROWS or bytes of rules than BROADCAST_BYTES. No step recurses, so depth is no limit.

    Blocks are joined by one line feed; inside a block, white space is one space and character references are decoded.

    Nulls: a null page has the empty text; pages with a null url, or one without a host, share one wrapper; ids may be null. Empty
    and long pages are taken whole. Repeated rows are extracted each. Empty table: no rows. Other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    rules = written(host_rules(rows), "html-rules")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rules")), F.lit(0))).first()[0]
    kinds = dict(rows.dtypes)
    out = rows.join(small_enough(rules, BROADCAST_ROWS) if size <= BROADCAST_BYTES else rules, "host", "left").select("id", "url", "html", "rules").mapInArrow(_texts, f"id {kinds['id']}, url {kinds['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def query(pages: DataFrame) -> DataFrame:
    return extract_text(pages)
