"""References inside a text: images, anchors, page numbers. All are column expressions.

A text is cut at the matches of a pattern into an array of segments, of which a match begins
with a mark; rules then rewrite matches one by one, with look-ups where they need them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

IMAGE = r"!\[[^\]]*\]\([^)]+\)"
_IMAGE = r"(?s)^!\[([^\]]*)\]\(([^)]+)\)$"
LINK = r"\[[^\]]+\]\(#[^)]+\)"
_LINK = r"(?s)^\[([^\]]+)\]\(#([^)]+)\)$"
PAGE_LINK = r"\[[^\]]+\]\(#page-\d+-\d+\)"
PAGE_MARK = r'id="page-\d+-\d+"|\(#page-\d+-\d+\)'
PLACEHOLDER = "<!-- image -->"
DEAD_IMAGE = r"^\s*!\[[^\]]*\]\(\s*data:[^)]*\)\s*$"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")
_ON, _AT = "\u0001", "\u0002"


def segments(md: Column, pattern: str) -> Column:
    """The text in pieces; those that match begin with a mark."""
    return F.split(F.regexp_replace(md, f"({pattern})", f"{_ON}{_AT}$1{_ON}"), _ON)


def rewrite(md: Column, pattern: str, rule) -> Column:
    """The text with each match replaced by what the rule makes of it."""
    one = lambda s: F.when(F.startswith(s, F.lit(_AT)), rule(F.substring(s, 2, 1 << 30))).otherwise(s)
    return F.array_join(F.transform(segments(md, pattern), one), "")


def matches(md: Column, pattern: str) -> Column:
    return F.regexp_extract_all(md, F.lit(f"({pattern})"), 1)


def alt_of(ref: Column) -> Column:
    return F.regexp_extract(ref, _IMAGE, 1)


def target_of(ref: Column) -> Column:
    return F.regexp_extract(ref, _IMAGE, 2)


def label_of(ref: Column) -> Column:
    return F.regexp_extract(ref, _LINK, 1)


def anchor_of(ref: Column) -> Column:
    return F.regexp_extract(ref, _LINK, 2)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def prefix_images(md: Column, page_range: Column) -> Column:
    """``images/x`` becomes ``images/<range>-x``, so that chunks of a document don't share names."""
    return F.array_join(F.transform(segments(md, IMAGE), lambda s: _prefixed(s, page_range)), "")


def _prefixed(s: Column, page_range: Column) -> Column:
    ref = F.substring(s, 2, 1 << 30)
    path = target_of(ref)
    own = F.concat(F.lit("!["), alt_of(ref), F.lit("]("), F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1), page_range, F.lit("-"), basename(path), F.lit(")"))
    return F.when(~F.startswith(s, F.lit(_AT)), s).when(F.startswith(path, F.lit("images/")), own).otherwise(ref)


def absolute_pages(md: Column, offset: Column) -> Column:
    """Page numbers of anchors and of references to them, counted from the document's first page."""

    def rule(m: Column) -> Column:
        number = F.regexp_extract(m, r"page-(\d+)-", 1).cast("bigint") + offset
        return F.concat(F.regexp_extract(m, r"^(.*page-)\d+", 1), number.cast("string"), F.regexp_extract(m, r"page-\d+(-.*)$", 1))

    return rewrite(md, PAGE_MARK, rule)


def fill_placeholders(md: Column, refs: Column) -> Column:
    """The k-th image placeholder becomes the k-th reference; a reference more than there are places goes to the end, further ones are dropped."""
    parts = F.split(md, PLACEHOLDER)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(refs, i), F.lit("")))), "")


def drop_dead_images(md: Column) -> Column:
    """Without lines that are only an image of inline data; at most one blank line in a row."""
    kept = F.filter(F.split(md, "\n"), lambda x: ~x.rlike(DEAD_IMAGE))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")


def parse_page_range(spec: Column) -> Column:
    """``0-3,5,7-9`` as its pages, ascending and once each."""

    def part(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_extract(p, r"(\d+)$", 1).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, part))))


def one_based_range(spec: Column) -> tuple[Column, Column]:
    """First and last page counted from one; null without pages."""
    pages = parse_page_range(spec)
    return F.array_min(pages) + 1, F.array_max(pages) + 1


def _path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def flat_name(path: Column) -> Column:
    """What stands behind the folder ``images``, else the last two parts, joined by hyphens."""
    parts = _path_parts(path)
    at = F.array_position(parts, "images")
    return F.array_join(F.when(at > 0, F.slice(parts, F.greatest(at + 1, F.lit(1)).cast("int"), F.size(parts))).when(F.size(parts) >= 2, F.slice(parts, -2, 2)).otherwise(parts), "-")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def local_name(url: Column) -> Column:
    return flat_name(url_path(url))


def is_image_url(url: Column) -> Column:
    """Whether a reference's address names an image or nothing at all."""
    path = F.when(url.rlike(r"^[a-z]+://"), url_path(url)).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))
    suffix = F.lower(F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"[^/.][^/]*(\.[^./]+)$", 1))
    return (suffix == "") | suffix.isin(*IMAGE_SUFFIXES)


def download_targets(md: Column) -> Column:
    """Addresses of remote images in the order of their first occurrence."""
    found = F.regexp_extract_all(md, F.lit(r"!\[[^\]]*\]\((https?://[^)\s]+)\)"), 1)
    return F.array_distinct(F.filter(found, is_image_url))


def image_suffix(data: Column) -> Column:
    """Suffix that an image's first bytes tell."""
    head = F.hex(F.substring(data, 1, 512))
    text = F.lower(F.regexp_replace(F.decode(F.substring(data, 1, 512), "ISO-8859-1"), r"^\s+", ""))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), ".png").when(head.startswith("FFD8FF"), ".jpg").when(head.rlike("^47494638(37|39)61"), ".gif")
        .when(head.rlike("^52494646.{8}57454250"), ".webp").when(text.rlike(r"^(<svg|<\?xml)"), ".svg").otherwise(".png")
    )


def address_is_blocked(address: Column) -> Column:
    """Whether an IPv4 address is private, loopback, link-local, reserved, multicast or no address at all."""
    p = [F.regexp_extract(address, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]
    a, b, c = p[0], p[1], p[2]
    bad = (a.isin(0, 10, 127)) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.coalesce(bad | (F.greatest(*p) > 255), F.lit(True))
