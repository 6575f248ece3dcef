"""Text clean-up, checks and renderings as Columns: all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GARBLED = "�"
#: Units that count as physical, and ASCII spellings of superscripts.
UNITS = ["V", "A", "Ω", "W", "J", "N", "Pa", "Hz", "kg", "g", "mg", "m", "cm", "mm", "km", "mL", "L", "s", "h", "min", "m²", "cm²", "m³", "cm³", "m/s", "m/s²", "km/h", "kg/m³", "g/cm³", "℃", "%"]
VARIANTS = {"kg/m3": "kg/m³", "g/cm3": "g/cm³", "m3": "m³", "cm3": "cm³", "m2": "m²", "cm2": "cm²", "m/s2": "m/s²"}
#: A number and up to eight unit characters after it.
NUMBER = r"(\d+(?:[.．]\d+)?)\s*([A-Za-z0-9Ω℃³²/%]{0,8})"
#: Patterns of page footers, picture marks, links, option marks, bare formulas and question starts.
FOOTERS = (r"第\s*\d+\s*页[（(]共\s*\d+\s*页[）)]", r"第\s*\d+\s*页")
PICTURE_MARKS = ((r"(?i)\[figure\][^\s\]\[]*", ""), (r"(?i)\[img\][^\s\]\[]*", ""), (r"(?i)\[(图片|图|figure|img)\]", ""), (r"!\[([^\]]*)\]\([^)]+\)", "$1"))
LINK = r"\[([^\]]+)\]\([^)]+\)"
OPTION_MARK = r"(?m)(?:^|\s)[A-D]\s*[.．、]"
BARE_FORMULA = r"\d+[xXyYzZ]\s*[-+=]"
START = (r"^\s*(?:[（(]多选[）)])?\s*", r"\s*(?:[.．、]|[（(]\s*\d+\s*分)")
FILE_ENDING = r"(?i)\.(pdf|docx?|pptx?|txt)$"


def strip(text: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def present(text: Column) -> Column:
    """Whether a text is neither null nor blank; never null."""
    return text.isNotNull() & (F.trim(text) != "")


def contains_any_case(text: Column, term: str) -> Column:
    """Literal search without regard to case: % and _ mean themselves."""
    return F.contains(F.lower(text), F.lit(term.lower()))


def like_any_case(text: Column, pattern: str) -> Column:
    """Search with % and _ as wildcards and no escape character."""
    return F.lower(text).like("%" + pattern.lower().replace("\\", "\\\\") + "%")


def cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def snippet(text: Column, n: int = 80) -> Column:
    """A preview: no formula fences, picture marks, links and emphasis; white space as one space; at most n characters."""
    t = F.coalesce(text, F.lit(""))
    for mark in ("\\(", "\\)", "\\[", "\\]"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    for pattern, to in PICTURE_MARKS:
        t = F.regexp_replace(t, pattern, to)
    for mark in ("**", "__", "~~"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    t = F.regexp_replace(t, LINK, "$1")
    return cut(strip(F.regexp_replace(t, r"(?U)\s+", " ")), n)


def file_title(name: Column) -> Column:
    return F.regexp_replace(name, FILE_ENDING, "")


def mask_key(key: Column) -> Column:
    """First and last four characters of a key; null for short or missing ones."""
    return F.when(F.length(key) >= 8, F.concat(F.left(key, F.lit(4)), F.lit("****"), F.right(key, F.lit(4))))


def escape_html(text: Column) -> Column:
    for mark, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(to))
    return text


def bold(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*(.+?)\*\*", "<b>$1</b>")


def plain_number(x: Column) -> Column:
    """A number without trailing zeros: 2.0 as 2, 2.50 as 2.5."""
    return F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", "")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def unfenced(text: Column) -> Column:
    """The inside of a fenced code block, or the text itself."""
    inside = F.regexp_extract(text, r"(?s)^\s*```[^\n]*\n(.*?)```", 1)
    return F.when(inside != "", inside).otherwise(text)


def clean_up(text: Column) -> Column:
    """Known reading errors mended: page footers, runs of empty lines, blanks at line ends; replacement marks and boxes go, full-width minus and equals signs become ASCII ones."""
    t = text
    for pattern in FOOTERS:
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?md)[ \t]+$", "")
    return strip(F.translate(t, "﹣＝" + GARBLED + "□", "-="))


def problems(content: Column, options: Column) -> Column:
    """Struct of severity, problems and needs_llm for a text and its options (array of structs with content).

    Worst first: too short, garbled, empty or unparsed options need a model; bare formulas and split lines need a fix.
    """
    body = F.coalesce(content, F.lit(""))
    none = options.isNull() | (F.size(options) == 0)
    empty = F.when(none, 0).otherwise(F.size(F.filter(options, lambda o: F.trim(F.coalesce(o["content"], F.lit(""))) == "")))
    garbled = F.length(body) - F.length(F.replace(body, F.lit(GARBLED), F.lit("")))
    lines = F.split(body, "\n")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)).between(1, 4)))
    found = [
        (2, "too_short", F.length(F.trim(body)) < 10),
        (2, "garbled", garbled > 0),
        (2, "empty_options", empty > 0),
        (2, "unparsed_options", none & (F.regexp_count(body, F.lit(OPTION_MARK)) >= 2)),
        (1, "bare_formula", F.regexp_like(body, F.lit(BARE_FORMULA))),
        (1, "split_lines", short > F.size(lines) * 0.3),
    ]
    level = F.greatest(*[F.when(hit, rank).otherwise(0) for rank, _, hit in found])
    return F.struct(F.element_at(F.array(F.lit("good"), F.lit("needs_fix"), F.lit("needs_ai")), level + 1).alias("severity"), F.array_compact(F.array(*[F.when(hit, name) for _, name, hit in found])).alias("problems"), (level == 2).alias("needs_llm"))


def section_type(title: Column) -> Column:
    """The question type that a section's title announces: the first rule that applies."""
    rules = (("multiple_choice", ("多项选择",)), ("single_choice", ("单项选择", "选择题")), ("fill_blank", ("填空",)), ("comprehensive", ("综合", "解答", "简答", "论述", "计算")), ("experiment", ("实验",)))
    out = F.lit("unknown")
    for kind, words in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(title, F.lit(w)) for w in words]), kind).otherwise(out)
    return F.when(title.isNull(), "unknown").otherwise(out)


#: Marks of blanks to fill, and of texts in several parts.
BLANKS = ("___", "＿＿＿", "（  ）", "(  )", "（）", "()")
PARTS = ("（1）", "(1)", "①", "解：", "证明：")


def corrected_type(kind: Column, content: Column, options: Column) -> Column:
    """The type that a question's content allows: with options a choice, without them none."""
    body = F.coalesce(content, F.lit(""))
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(body, F.lit(w)) for w in words])
    choice = F.coalesce(F.size(options), F.lit(0)) >= 2
    no_choice = kind.isin("fill_blank", "comprehensive", "experiment", "calculation", "short_answer", "essay")
    other = F.when(any_of(BLANKS), "fill_blank").when(any_of(PARTS) | (F.length(body) > 150), "comprehensive").otherwise("fill_blank")
    return F.when(choice, F.when(no_choice | kind.isNull(), "single_choice").otherwise(kind)).when(kind.isin("single_choice", "multiple_choice"), other).otherwise(F.coalesce(kind, F.lit("unknown")))


def numbers_with_units(text: Column) -> Column:
    """Array of (number, unit) for physical units, with a plain decimal point and superscripts."""
    numbers, units = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2))
    variants = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])
    pairs = F.zip_with(numbers, units, lambda n, u: F.struct(F.translate(n, "．", ".").alias("number"), F.coalesce(F.try_element_at(variants, u), u).alias("unit")))
    return F.filter(pairs, lambda p: p["unit"].isin(*UNITS))


def unit_warnings(text: Column) -> Column:
    """Doubtful spellings of units: missing superscripts, doubled units, a letter after a decimal point."""
    missing = [F.when(F.contains(text, F.lit(v)) & F.regexp_like(text, F.lit(rf"(?<![A-Za-z/]){v}(?![A-Za-z0-9])")), F.lit(f"superscript:{v}")) for v in VARIANTS]
    doubled = F.transform(F.regexp_extract_all(text, F.lit(r"((\d+(?:[.．]\d+)?)\s*([A-Za-zΩ]{1,3})\3(?![A-Za-z]))"), F.lit(1)), lambda m: F.concat(F.lit("doubled:"), m))
    odd = F.transform(F.regexp_extract_all(text, F.lit(r"(\d\.[A-Za-z])"), F.lit(1)), lambda m: F.concat(F.lit("decimal:"), m))
    return F.concat(F.array_compact(F.array(*missing)), doubled, odd)


def native_quality(text: Column, number: Column) -> Column:
    """From 0 to 1: less for replacement marks (0.08 each, 0.45 at most), a wrong start and a short text; 0 for none."""
    body = F.coalesce(text, F.lit(""))
    marks = F.length(body) - F.length(F.translate(body, GARBLED + "□", ""))
    starts = F.regexp_like(body, F.concat(F.lit(START[0]), number.cast("string"), F.lit(START[1])))
    score = 1.0 - F.least(F.lit(0.45), marks * 0.08) - F.when(starts, 0.0).otherwise(0.25) - F.when(F.length(body) < 12, 0.25).otherwise(0.0)
    return F.when(body == "", F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), score), 4))


def native_warnings(text: Column, number: Column) -> Column:
    """What native_quality finds: empty, or replaced:n, start, short."""
    body = F.coalesce(text, F.lit(""))
    marks = F.length(body) - F.length(F.translate(body, GARBLED + "□", ""))
    starts = F.regexp_like(body, F.concat(F.lit(START[0]), number.cast("string"), F.lit(START[1])))
    found = F.array(F.when(marks > 0, F.concat(F.lit("replaced:"), marks.cast("string"))), F.when(~starts, "start"), F.when(F.length(body) < 12, "short"))
    return F.when(body == "", F.array(F.lit("empty"))).otherwise(F.array_compact(found))


def selected_text(native: Column, ocr: Column, score: Column) -> Column:
    """The better reading: the other one where the native text is broken, else the native one if good, else what there is."""
    garbled = F.length(native) - F.length(F.replace(native, F.lit(GARBLED), F.lit("")))
    some = F.coalesce(ocr, F.lit("")) != ""
    return F.when((garbled >= 3) & some, ocr).when((native != "") & (score >= 0.7), native).when(some, ocr).otherwise(native)


def review_score(native_score: Column, ocr_confidence: Column, conflict: Column, warnings: Column) -> Column:
    """0.6 native + 0.4 OCR, less 0.15 for a conflict and 0.03 for each of up to three warnings, within 0 and 1."""
    base = F.when(ocr_confidence.isNull(), native_score).otherwise(0.6 * native_score + 0.4 * ocr_confidence)
    penalty = F.when(conflict, 0.15).otherwise(0.0) + 0.03 * F.least(warnings, F.lit(3))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty)), 4)


def clean_css(style: Column) -> Column:
    """The declarations of a style that are allowed and harmless."""
    allowed = ["font-family", "font-size", "color", "line-height", "margin-top", "margin-bottom", "margin-left", "text-indent", "text-align"]
    parts = F.transform(F.split(style, ";"), lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("p"), F.trim(F.substring(d, F.instr(d, ":") + 1, F.length(d))).alias("v"), (F.instr(d, ":") > 0).alias("ok")))
    bad = lambda v: F.regexp_like(F.lower(v), F.lit(r"url\(|expression\(|javascript"))
    kept = F.filter(parts, lambda d: d["ok"] & d["p"].isin(*allowed) & (d["v"] != "") & ~bad(d["v"]))
    return F.array_join(F.transform(kept, lambda d: F.concat(d["p"], F.lit(": "), d["v"])), "; ")


def asset_urls(content: Column, document: Column, base: str = "/api/ocr-assets") -> Column:
    """Asset references as addresses of the document's assets; those of practices stay."""
    return F.regexp_replace(content, F.lit(r"asset://(?!practice/)"), F.concat(F.lit(base + "/"), document, F.lit("/")))


#: A formula, and a reference to a picture.
HAS_FORMULA = r"\$\$([^$]+?)\$\$|\\\[(.+?)\\\]|(?<![\d$])\$(?!\$)([^$\n]+?)\$(?!\$)|\\\((.+?)\\\)"
HAS_PICTURE = r"asset://[^\s)\"]+|/api/practices/[^\s)\"]+"


def has_formula(text: Column) -> Column:
    return F.regexp_like(text, F.lit(HAS_FORMULA))


def picture_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAS_PICTURE))


def options_have_picture(options: Column) -> Column:
    """Whether one of the options (label, content) refers to a picture."""
    return F.coalesce(F.exists(options, lambda o: F.coalesce(F.regexp_like(o["content"], F.lit(HAS_PICTURE)), F.lit(False))), F.lit(False))


def served_assets(text: Column, source: Column, base: str = "/api/ocr-assets") -> Column:
    """References to assets as addresses below their source, a doubled folder of figures once; without a source they stay."""
    single = F.replace(text, F.lit("asset://figures/figures/"), F.lit("asset://figures/"))
    return F.when(source.isNull(), text).otherwise(F.regexp_replace(single, F.lit(r"asset://(?=[^\s)])"), F.concat(F.lit(base + "/"), source, F.lit("/"))))


def served_options(options: Column, source: Column) -> Column:
    return F.transform(options, lambda o: F.struct(o["label"].alias("label"), served_assets(o["content"], source).alias("content")))


def served_card(path: Column, source: Column, base: str = "/api/ocr-assets") -> Column:
    """A card's path on disk as an address: what follows the document's folder below ocr_output. Other paths, and relative ones, stay."""
    slashed = F.translate(path, "\\", "/")
    inner = F.regexp_extract(slashed, r"(?:^|/)ocr_output/[^/]+/(.*)$", 1)
    on_disk = F.contains(path, F.lit("\\")) | path.startswith("/")
    return F.when(source.isNotNull() & on_disk & (inner != ""), F.concat(F.lit(base + "/"), source, F.lit("/"), inner)).otherwise(path)


def set_attributes(attrs: Column) -> Column:
    """A map of paragraph attributes without those that are null, zero, false, empty or the default alignment."""
    return F.map_filter(attrs, lambda k, v: v.isNotNull() & ~v.isin("", "0", "false") & ~((k == "textAlign") & (v == "left")))


#: A picture with its text and address; fences of formulas.
PICTURE = r"!\[([^\]]*)\]\(([^)]+)\)"
BLOCK_FORMULA, INLINE_FORMULA = r"(?s)\$\$(.+?)\$\$|\\\[(.+?)\\\]", r"(?<!\\)\$(?!\$)([^$\n]+?)\$|(?s)\\\((.+?)\\\)"
#: The style of pictures in full texts, previews and options.
FULL_STYLE = "max-width:min(100%, 400px);max-height:300px;height:auto;margin:4px 0;border-radius:4px;"
PREVIEW_STYLE = "max-width:100px;max-height:70px;margin:2px;border-radius:3px;vertical-align:middle;"
OPTION_STYLE = "max-height:40px;vertical-align:middle;margin:0 4px;border-radius:3px;"
#: Light mark-up and what it becomes in a full text, in this order.
MARKDOWN = ((r"\*\*(.+?)\*\*", "<b>$1</b>"), (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "<i>$1</i>"), (r"(?m)^#### (.+)$", "<h5>$1</h5>"), (r"(?m)^### (.+)$", "<h4>$1</h4>"), (r"(?m)^## (.+)$", "<h3>$1</h3>"), (r"(?m)^# (.+)$", "<h2>$1</h2>"), (r"(?m)^- (.+)$", "<li>$1</li>"), (r"(?m)^\d+\. (.+)$", "<li>$1</li>"))


def _picture(style: str) -> str:
    return f'<img src="$2" alt="$1" style="{style}" loading="lazy" />'


def _formulas(text: Column) -> Column:
    """Formulas as elements that a typesetter fills; the typesetting itself isn't data processing."""
    text = F.regexp_replace(text, BLOCK_FORMULA, '<span class="math block">$1$2</span>')
    return F.regexp_replace(text, INLINE_FORMULA, '<span class="math">$1$2</span>')


def rendered_full(text: Column, pictures: int | None = 20, empty: str = "") -> Column:
    """A text as HTML: formulas, at most so many pictures (None: none), emphasis, headings, list items, line breaks."""
    html = _formulas(F.coalesce(text, F.lit("")))
    if pictures is None:
        html = F.regexp_replace(html, PICTURE, "")
    else:
        parts, found = F.split(html, PICTURE, -1), F.regexp_extract_all(html, F.lit(f"({PICTURE})"), F.lit(1))
        shown = F.transform(found, lambda p, i: F.when(i < pictures, F.regexp_replace(p, PICTURE, _picture(FULL_STYLE))).otherwise(""))
        html = F.array_join(F.zip_with(parts, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    for pattern, to in MARKDOWN:
        html = F.regexp_replace(html, pattern, to)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(empty)).otherwise(F.replace(html, F.lit("\n"), F.lit("<br>")))


def rendered_preview(text: Column, n: int = 150) -> Column:
    """At most n characters without mark-up, and the pictures as thumbnails below."""
    t = F.coalesce(text, F.lit(""))
    thumbs = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(f"({PICTURE})"), F.lit(1)), lambda p: F.regexp_replace(p, PICTURE, _picture(PREVIEW_STYLE))), "")
    plain = F.regexp_replace(F.regexp_replace(t, PICTURE, ""), r"(?s)\$\$\s*(.+?)\s*\$\$", "[$1]")
    plain = F.regexp_replace(plain, r"(?<!\\)\$(?!\$)[ \t]*([^$\n]+?)[ \t]*\$", "$1")
    for pattern, to in ((MARKDOWN[0][0], "$1"), (MARKDOWN[1][0], "$1"), (r"(?m)^#{1,4}\s+", "")):
        plain = F.regexp_replace(plain, pattern, to)
    plain = F.when(F.length(plain) > n, F.concat(F.left(plain, F.lit(n)), F.lit("..."))).otherwise(plain)
    return F.concat(plain, F.when(thumbs != "", F.concat(F.lit('<div style="margin-top:4px;">'), thumbs, F.lit("</div>"))).otherwise(""))


def rendered_option(text: Column) -> Column:
    """An option's formulas, and its pictures in the line."""
    return F.regexp_replace(_formulas(F.coalesce(text, F.lit(""))), PICTURE, _picture(OPTION_STYLE))


OPTION = "array<struct<label: string, content: string>>"


def normal_options(options: Column) -> Column:
    """label, content of each item of a JSON array: objects as they are, texts under the letter of their place; other items go. What is no array gives null."""
    items = F.from_json(options, "array<variant>")

    def one(item: Column, i: Column) -> Column:
        letter = F.char(F.lit(65) + i)
        kind = F.schema_of_variant(item)
        given = F.struct(F.coalesce(F.try_variant_get(item, "$.label", "string"), letter).alias("label"), F.coalesce(F.try_variant_get(item, "$.content", "string"), F.lit("")).alias("content"))
        said = F.struct(letter.alias("label"), F.try_variant_get(item, "$", "string").alias("content"))
        return F.when(F.startswith(kind, F.lit("OBJECT")), given).when(kind == "STRING", said)

    return F.array_compact(F.transform(items, one)).cast(OPTION)


#: Dots of an inch of screen and page, and lengths of an inch and a centimetre in units of a page.
DPI, INCH, CENTIMETRE = 96, 914_400, 360_000
#: The tallest picture that fits, and the tallest of all, in centimetres.
FIT_HEIGHT, MOST_HEIGHT = 8, 24


def page_units(pixels: Column) -> Column:
    return F.floor(pixels.cast("long") * INCH / DPI).cast("long")


def fitted_width(width: Column, height: Column, room: int) -> Column:
    """Width of a picture of this size in pixels on a page: at most half of the room, no taller than FIT_HEIGHT; null where it stays as it is."""
    w, h = page_units(width), page_units(height)
    cap, fit, most = room // 2, FIT_HEIGHT * CENTIMETRE, MOST_HEIGHT * CENTIMETRE
    lower = F.when(h > fit, F.floor(w * fit / h)).otherwise(w)
    lower = F.when(h > most, F.least(lower, F.floor(lower * most / h))).otherwise(lower).cast("long")
    return F.when(lower >= cap, F.lit(cap).cast("long")).when(lower != w, lower)
