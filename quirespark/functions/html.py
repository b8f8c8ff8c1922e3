"""HTML to markdown as column expressions, so that a whole crawl stays in the JVM."""

from __future__ import annotations

import html as _html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip, sub

_DROPPED = ("head", "script", "style", "nav", "footer", "noscript")
_BLOCK = "p|div|ul|ol|article|section|main|body|html|table|tr|blockquote|pre|header"
#: (pattern, replacement) in order; both this engine's and the checking engine's regular expressions read them.
MARKDOWN = (
    *((rf"(?is)<{t}(?:\s[^>]*)?>.*?</{t}\s*>", "") for t in _DROPPED),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(?:div|p|span)\s[^>]*(?:display:\s*none|visibility:\s*hidden|aria-hidden=.true)[^>]*>[^<]*</(?:div|p|span)>", ""),
    (r"(?is)<img\s[^>]*?src=\"([^\"]*)\"[^>]*>", "![]({1})"),
    (r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[{2}]({1})"),
    (r"(?is)<(?:b|strong)>([^<]*)</(?:b|strong)>", "**{1}**"),
    (r"(?is)<(?:i|em)>([^<]*)</(?:i|em)>", "*{1}*"),
    (r"(?i)<li(?:\s[^>]*)?>", "\n* "),
    (r"(?i)<br\s*/?>", "\n"),
    *((rf"(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}>", "\n\n" + "#" * n + " {1}\n\n") for n in range(1, 7)),
    (rf"(?i)</?(?:{_BLOCK})(?:\s[^>]*)?>", "\n\n"),
    (r"<[^>]*>", ""),
)
SQUEEZE = ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))


def html_to_markdown(html: Column, bold_headings: bool = False) -> Column:
    """Markdown of a page; with ``bold_headings`` the headings of a fragment become bold text."""
    c = html
    for pattern, to in MARKDOWN:
        if bold_headings and to.strip().startswith("#"):
            to = "\n\n**{1}**\n\n"
        c = sub(c, pattern, to.replace("$", "\\$").replace("{1}", "$1").replace("{2}", "$2"))
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    for pattern, to in SQUEEZE:
        c = sub(c, pattern, to)
    return strip(c)


def drop_hidden(html: Column) -> Column:
    """The page without scripts, styles, comments and hidden elements; all else stays."""
    c = html
    for pattern, to in (*MARKDOWN[1:3], *MARKDOWN[6:8]):
        c = sub(c, pattern, to)
    return c


def latex_from_alt(alt: Column) -> Column:
    """What follows ``LaTeX:`` in an equation image's alternative text; null without it."""
    x = strip(F.regexp_extract(alt, r"(?is)^\s*LaTeX:\s*(.+)$", 1))
    return F.when(x != "", x)


@F.pandas_udf(StringType())
def unescape_udf(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Every named and numbered entity of HTML 5; for texts that the usual ones don't cover."""
    for s in cells:
        yield s.map(lambda x: _html.unescape(x) if isinstance(x, str) else None)
