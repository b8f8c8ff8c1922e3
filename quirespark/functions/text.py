"""Line-level clean-up rules as column expressions; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where Python's ``splitlines`` breaks a text.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: What ``\\s`` stands for.
SPACE = " \t\n\x0b\f\r"
PAGE_SPAN = r'<span id="page-\d+-\d+"></span>'


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE))


def split_lines(md: Column) -> Column:
    """Lines of a text, without the empty one behind a final line break."""
    whole = lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    return F.element_at(F.transform(F.array(F.split(md, LINE_BREAK)), whole), 1)  # bound, so that the text's expression is there once


def outside_fences(md: Column, rule) -> Column:
    """Applies a text rule to what lies outside closed code fences."""
    parts = F.split(sub(md, r"(?s)(```.*?```)", "\u0001\u0002$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("\u0002")), F.substring(p, 2, 1 << 30)).otherwise(rule(p))), "")


_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#x27", "'"), ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("deg", "°"), ("middot", "·"), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("rsquo", "’"), ("lsquo", "‘"), ("rdquo", "”"), ("ldquo", "“"), ("times", "×"), ("micro", "µ"), ("eacute", "é"), ("amp", "&"))


def decode_entities(c: Column) -> Column:
    """The usual named entities; the ampersand comes last, so nothing is decoded twice. The full table is in ``html.unescape_udf``."""
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def collapse_emphasis(line: Column) -> Column:
    return F.when(line.rlike(r"^\s*\*{3,}\s*$"), line).otherwise(sub(line, r"\*{4,}", "**"))


def strip_control(c: Column) -> Column:
    return sub(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]")


def strip_non_ascii(c: Column) -> Column:
    return sub(c, r"[^\x09\x0A\x0D\x20-\x7E]")


def strip_page_spans(c: Column) -> Column:
    return sub(c, PAGE_SPAN)


def strip_inline_tags(c: Column) -> Column:
    return sub(c, r"(?i)</?(i|b|strong)>")


def collapse_spaces(c: Column) -> Column:
    return sub(c, r"\s{2,}", " ")


def strip_page_refs(c: Column) -> Column:
    return sub(c, r"\[([^\]]+)\]\(#page-\d+-\d+\)", "$1")


def unescape_underscores(c: Column) -> Column:
    return F.replace(c, F.lit("\\_"), F.lit("_"))


CROSS_REF = r"\[?([A-Za-z][^\]]{1,80})\]?\(#(page-\d+-\d+)\)"
#: How a reference's address begins, and the most characters of one before it: a bracket, a label of 81 and a bracket.
_ADDRESS, _REACH = "(#page-", 83


def repair_cross_ref(c: Column) -> Column:
    """``Se[e Foo](#page-1-2)`` to ``[See Foo](#page-1-2)``: a label loses the brackets inside it, unless a space stands before the first.

    The pattern tries a label at every letter, so it is kept to what is near an address.
    """
    near = F.transform(F.split(_near_addresses(c), "\u0001"), lambda p, i: F.when(i % 2 == 1, p).otherwise(_repaired(p)))
    return F.when(F.contains(c, F.lit("\u0001")), _repaired(c)).when(F.contains(c, F.lit(_ADDRESS)), F.array_join(near, "")).otherwise(c)


def _near_addresses(c: Column) -> Column:
    """The text with a mark on both sides of each stretch that no reference reaches into: from behind one address to 83 characters before the next."""
    parts = F.split(c, r"\(#page-")

    def mark(p: Column, i: Column) -> Column:
        head = F.when(i > 0, F.instr(p, ")")).otherwise(0)
        far = F.length(p) - head - F.when(i < F.size(parts) - 1, _REACH).otherwise(0)
        cut = F.concat(F.substring(p, F.lit(1), head), F.lit("\u0001"), F.substring(p, head + 1, far), F.lit("\u0001"), F.substring(p, head + far + 1, F.length(p)))
        return F.when(far > 0, cut).otherwise(p)

    return F.array_join(F.transform(parts, mark), _ADDRESS)


def _repaired(c: Column) -> Column:
    cut = F.split(sub(c, f"({CROSS_REF})", "\u0001\u0002$1\u0001"), "\u0001")

    def one(m: Column) -> Column:
        label, anchor = F.regexp_extract(m, CROSS_REF, 1), F.regexp_extract(m, CROSS_REF, 2)
        return F.when(~F.contains(label, F.lit("[")) | label.rlike(r"^[^\[]* \["), m).otherwise(F.concat(F.lit("["), F.replace(label, F.lit("["), F.lit("")), F.lit("](#"), anchor, F.lit(")")))

    return F.array_join(F.transform(cut, lambda p: F.when(F.startswith(p, F.lit("\u0002")), one(F.substring(p, 2, 1 << 30))).otherwise(p)), "")


def promote_numbered(line: Column) -> Column:
    """``1.4.1. T`` to ``### 1.4.1. T``; existing headings lose stars around the text and levels beyond 6."""
    s = strip(line)
    hashes, content = F.regexp_extract(s, r"^(#+)\s*(.+?)\s*$", 1), F.regexp_extract(s, r"^(#+)\s*(.+?)\s*$", 2)
    depth = F.greatest(F.lit(1), F.least(F.length(hashes), F.lit(6)))
    trim = lambda c: strip(sub(c, r"^[* ]+|[* ]+$"))
    number = sub(F.regexp_extract(s, r"^(\d+(?:\.\d+)*\.)\s+(.+?)\s*$", 1), r"\.+$")
    title = F.regexp_extract(s, r"^(\d+(?:\.\d+)*\.)\s+(.+?)\s*$", 2)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return (
        F.when(F.startswith(s, F.lit("#")), F.when(hashes == "", line).otherwise(F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), trim(content))))
        .when((number == "") | (dots == 0), line)
        .otherwise(F.concat(F.repeat(F.lit("#"), F.least(dots + 1, F.lit(6))), F.lit(" "), number, F.lit(". "), trim(title)))
    )


def lock_depth(line: Column) -> Column:
    """Numbered headings get the level that their dots say, one more for a letter behind the number."""
    p = r"^(\s*)#+\s+(\d+\.\d+(?:\.\d+)*[a-z]?\.?\s+.+?)\s*$"
    body = F.regexp_extract(line, p, 2)
    number = F.regexp_extract(body, r"^(\d+(?:\.\d+)+)([a-z])?", 1)
    letter = F.length(F.regexp_extract(body, r"^(\d+(?:\.\d+)+)([a-z])?", 2))
    depth = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1 + letter
    return F.when(body == "", line).otherwise(F.concat(F.regexp_extract(line, p, 1), F.repeat(F.lit("#"), F.least(depth, F.lit(6))), F.lit(" "), body))


def heading_emphasis(line: Column) -> Column:
    p = r"^(\s*#{1,6}\s+)(.*)$"
    return F.when(line.rlike(p), F.concat(F.regexp_extract(line, p, 1), strip(sub(sub(F.regexp_extract(line, p, 2), r"\*\*|__"), r"\s{2,}", " ")))).otherwise(line)


def marker_pollution(text: Column) -> Column:
    c = sub(text, r'<span\s+id="[^"]*"\s*>\s*</span>')
    c = sub(c, r"\[([^\]]+)\]\(#page-\d+-\d+\)", "$1")
    return strip(sub(sub(c, r"\]\(#page-\d+-\d+\)"), r"\s+", " "))


def list_bullet(line: Column) -> Column:
    c = sub(line, r"^(\s*)\d+\.\s+([ⓐ-ⓩ].*)$", "$1$2")
    c = sub(c, r"(?i)^(\s*)-\s*o\s+(.+)$", "$1  - $2")
    c = sub(c, r"(?i)^(\s*)-\s*([a-z])\.\s+(.+)$", "$1  - $2) $3")
    return sub(c, r"(?i)^(\s*)-\s*([ivxlcdm]+)\.\s+(.+)$", "$1    - $2) $3")


def is_image_only(line: Column) -> Column:
    return line.rlike(r"^\s*!\[\]\([^)]+\)\s*$")


def is_table_line(line: Column) -> Column:
    s = strip(line)
    return F.startswith(s, F.lit("|")) & F.endswith(s, F.lit("|"))


def slug(line: Column) -> Column:
    """Anchor of a heading line."""
    c = F.lower(sub(strip(strip_page_spans(strip(line))), r"^#+\s*"))
    return sub(sub(sub(sub(c, r"\s+", "-"), r"[^a-z0-9-]"), r"-+", "-"), r"^-+|-+$")


def preserve_indent(original: Column, normalized: Column) -> Column:
    """List items keep their indent."""
    body = sub(normalized, r"^\s+")
    indent = F.regexp_extract(original, r"^[ \t]*", 0)
    return F.when((indent != "") & body.rlike(r"^(?:\d+\.|[-*+])\s"), F.concat(indent, body)).otherwise(normalized)


def bound(c: Column, *rules) -> Column:
    """Rules one after the other, each on a value that is named once, so that an expression grows by their sum and not by their product."""
    for rule in rules:
        c = F.element_at(F.transform(F.array(c), rule), 1)
    return c


def _heading_marks(c: Column) -> Column:
    p = r"^(\s*#{1,6}\s+)(.*)$"
    h = rstrip(strip_page_spans(c))
    return F.when(strip(c).startswith("#"), F.when(h.rlike(p), F.concat(F.regexp_extract(h, p, 1), marker_pollution(F.regexp_extract(h, p, 2)))).otherwise(h)).otherwise(c)


def clean_line(raw: Column, aggressive: bool = False, cross_refs: str = "keep") -> Column:
    """The rules of a line in their order, but for tables, blank runs and headings' anchors."""
    first = (lambda x: strip_page_spans(strip_non_ascii(rstrip(x)))) if aggressive else (lambda x: strip_control(rstrip(x)))
    refs = strip_page_refs if cross_refs == "strip" else (lambda x: x)
    return bound(
        raw, lambda x: strip_inline_tags(first(x)), lambda x: preserve_indent(x, strip(x)), lambda x: unescape_underscores(refs(repair_cross_ref(x))), promote_numbered, _heading_marks, list_bullet, lambda x: preserve_indent(x, rstrip(x)),
    )


def is_prose_title(title: Column) -> Column:
    t = strip(title)
    n = F.length(t)
    return (t != "") & ((n > 120) | ((n > 10) & F.substring(t, F.lit(1), n - 10).rlike(r"\. [A-Z]")) | ((n > 40) & t.rlike(r"[.?!]$")) | t.rlike(r"^\p{Ll}"))


def demote_prose(line: Column) -> Column:
    """Headings that are sentences or captions become plain lines, numbered ones list items."""
    s = strip(line)
    num = r"^(#+)\s+(\d+(?:\.\d+)*\.)\s+(.+?)$"
    title = strip(F.regexp_extract(s, r"^(#+)\s+(.+?)$", 2))
    ntitle = F.regexp_extract(s, num, 3)
    n = F.length(title)
    caption = title.rlike(r"(?i)^(?:Figure|Fig\.|Table|Tbl\.|Eq\.|Equation)\s+\d")
    upper = title.rlike(r"\p{Lu}") & ~title.rlike(r"\p{Ll}")
    prose = ((n > 40) & title.rlike(r"[.?!]$")) | ((n > 10) & F.substring(title, F.lit(1), n - 10).rlike(r"\. [A-Z]"))
    return (
        F.when(~F.startswith(s, F.lit("#")), line)
        .when(s.rlike(num), F.when(is_prose_title(ntitle), F.concat(F.regexp_extract(s, num, 2), F.lit(" "), ntitle)).otherwise(line))
        .when(title == "", line).when(caption, title).when(upper, line).when(prose, title).otherwise(line)
    )


def is_toc_phantom(text: Column) -> Column:
    """Whether a heading's text looks like an entry of a table of contents."""
    t = strip(text)
    page = r"(^|\W)\d{2,}\s*$"
    chapter = strip(F.regexp_extract(t, r"(?i)^Chapter\s+\d+\b(.*)$", 1))
    multi = strip(F.regexp_extract(t, r"^\d+(?:\.\d+)+\b(.*)$", 1))
    bare_no, bare = F.regexp_extract(t, r"^(\d+)\.\s+(.+)$", 1), strip(F.regexp_extract(t, r"^(\d+)\.\s+(.+)$", 2))
    fallback = F.lower(bare) == F.concat(F.lit("chapter "), bare_no)
    return t.rlike(r"(?i)\bp\.\s*\d+\s*$") | ((chapter != "") & chapter.rlike(page)) | ((multi != "") & multi.rlike(page)) | ((bare != "") & bare.rlike(page) & ~fallback)


def is_structural(text: Column) -> Column:
    """Chapter or multi-part numbered heading without a page number behind its title."""
    t = strip(text)
    page = r"(^|\W)\d{2,}\s*$"
    chapter = strip(F.regexp_extract(t, r"(?i)^Chapter\s+\d+\b(.*)$", 1))
    multi = strip(F.regexp_extract(t, r"^\d+(?:\.\d+)+\b(.*)$", 1))
    return (
        F.when(t.rlike(r"(?i)\bp\.\s*\d+\s*$"), False)
        .when(t.rlike(r"(?i)^Chapter\s+\d+\b"), ~((chapter != "") & chapter.rlike(page)))
        .when(t.rlike(r"^\d+(?:\.\d+)+\b"), ~((multi != "") & multi.rlike(page)))
        .otherwise(False)
    )


def heuristic_level(text: Column) -> Column:
    """Level that the numbering of a heading says; null where it says nothing."""
    t = strip(text)
    number = F.regexp_extract(t, r"^\d+(?:\.\d+)+\b", 0)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(t.rlike(r"(?i)^Chapter\s+\d+\b"), 1).when(number != "", F.least(dots + 1, F.lit(6))).when(t.rlike(r"^\d+\.\s+\S"), 1)


def clean_label(stem: Column) -> Column:
    return strip(sub(sub(stem, r"[_-]+", " "), r"\s+", " "))


LINK = r"\[([^\]]+)\]\([^)]+\)"


def strip_links(name: Column) -> Column:
    """``[a](b)`` to ``a``, inner links too: a pass takes one link of each nest at least, so there are as many passes as ends of links."""
    ends = F.regexp_count(name, F.lit(r"\]\("))
    return F.when(ends > 0, F.aggregate(F.sequence(F.lit(1), ends), name, lambda c, _: sub(c, LINK, "$1"))).otherwise(name)


def path_slug(name: Column) -> Column:
    """Lower-case letters, digits and dollar signs, all else a hyphen."""
    return sub(sub(F.lower(name), r"[^\p{L}\p{N}$]+", "-"), r"^-+|-+$")


def file_slug(name: Column) -> Column:
    """Stem of a section's file: its name without links as a slug, ``section`` when nothing is left, 200 characters at most."""
    c = path_slug(strip_links(name))
    return F.when(c == "", F.lit("section")).when(F.length(c) > 200, sub(F.substring(c, 1, 200), r"^-+|-+$")).otherwise(c)


def crumb(name: Column) -> Column:
    """A name as a link's label: without what would break the link or a table, 50 characters at most."""
    c = strip(sub(sub(name, r"[|\[\]()<>\\\n\r\t]+", " "), r"\s+", " "))
    return F.when(F.length(c) > 50, F.concat(rstrip(F.substring(c, 1, 50)), F.lit("…"))).otherwise(c)


def json_value(c: Column, array: bool = False) -> Column:
    """A value, or a list of texts, as JSON."""
    one = lambda x: sub(F.to_json(F.array(x)), r"^\[|\]$")
    return F.concat(F.lit("["), F.array_join(F.transform(c, one), ", "), F.lit("]")) if array else one(c)


def frontmatter(lists: tuple[str, ...] = (), **fields: Column) -> Column:
    """YAML block of JSON values in the given order; null fields are left out, and without any field there is no block."""
    rows = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), json_value(c, k in lists))) for k, c in fields.items()]
    body = F.concat_ws("\n", *rows)
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("---\n"), body, F.lit("\n---\n\n")))


def provenance(source_type: Column, source_label: Column, source_file: Column) -> Column:
    """Front matter of where a text is from, if a type or a label is known."""
    return F.when(source_type.isNull() & source_label.isNull(), F.lit("")).otherwise(frontmatter(source_type=source_type, source_label=source_label, source_file=source_file))


def source_id(name: Column) -> Column:
    """Slug of a file's stem, ASCII only."""
    return sub(sub(F.lower(sub(sub(name, r"^.*/"), r"\.[^.]*$")), r"[^a-z0-9]+", "-"), r"^-+|-+$")
