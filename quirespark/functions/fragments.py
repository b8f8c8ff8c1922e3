"""Fragments of HTML inside texts. Tags nest, so they are parsed; in Arrow batches, and only where a text has any."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "main", "body", "html", "figure", "figcaption", "header", "footer", "nav", "head", "noscript", "form", "dl", "dd", "dt", "address", "aside"}
_BULLETS = "*+-"
MOST_LINES = 400
_FENCE = re.compile(r"(```.*?```)", re.S)
_FENCED_BLOCK = re.compile(r"(^```.*?^```[ \t]*$)", re.M | re.S)


class _Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag, attrs=(), up=None):
        self.tag, self.attrs, self.kids, self.up = tag, dict(attrs), [], up

    def inside(self, *tags: str) -> bool:
        n = self.up
        while n is not None:
            if n.tag in tags:
                return True
            n = n.up
        return False

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("")

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, [(k, v or "") for k, v in attrs], self.at)
        self.at.kids.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def _hidden(n: _Node) -> bool:
    return n.tag in ("script", "style") or "display:none" in n.attrs.get("style", "").replace(" ", "").lower()


def _wrap(mark: str, text: str) -> str:
    """Marks go around what is not white space."""
    core = text.strip()
    if not core:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def _children(n: _Node, media, depth: int) -> str:
    return "".join(_render(k, media, depth) for k in n.kids)


def _table(n: _Node, media) -> str:
    rows: list[tuple[bool, list[str]]] = []

    def walk(x: _Node) -> None:
        for k in x.kids:
            if isinstance(k, str) or _hidden(k):
                continue
            if k.tag == "tr":
                cells = [c for c in k.kids if not isinstance(c, str) and c.tag in ("td", "th")]
                rows.append((bool(cells) and all(c.tag == "th" for c in cells), [" ".join(_children(c, media, 0).split()) for c in cells]))
            elif k.tag != "table":
                walk(k)

    walk(n)
    rows = [r for r in rows if r[1]]
    if not rows:
        return ""
    width = max(len(c) for _, c in rows)
    head = rows[0][1] if rows[0][0] else [""] * width
    body = rows[1:] if rows[0][0] else rows
    line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
    return "\n\n" + "\n".join([line(head), line(["---"] * width), *[line(c) for _, c in body]]) + "\n\n"


def _list(n: _Node, media, depth: int) -> str:
    out, number = [], int(n.attrs.get("start") or 1) if (n.attrs.get("start") or "1").isdigit() else 1
    for k in n.kids:
        if isinstance(k, str) or k.tag != "li":
            continue
        mark = f"{number}." if n.tag == "ol" else _BULLETS[depth % 3]
        number += 1
        text = re.sub(r"\n{2,}", "\n", _children(k, media, depth + 1)).strip()
        pad = " " * (len(mark) + 1)
        out.append(f"{mark} " + text.replace("\n", "\n" + pad))
    inner = "\n".join(out)
    return f"\n{inner}\n" if n.inside("ul", "ol") else f"\n\n{inner}\n\n"


def _render(n, media, depth: int = 0) -> str:
    if isinstance(n, str):
        return re.sub(r"\s+", " ", n)
    if _hidden(n):
        return ""
    a = n.attrs
    if n.tag == "img":
        if "equation_image" in a.get("class", "").split():
            alt = a.get("alt", "")
            latex = a.get("data-equation-content", "") or (alt[6:].strip() if alt.startswith("LaTeX:") else "")
            return f"${latex}$" if latex else ""
        src = a.get("src", "")
        if media is not None:
            src = media(src)
            if not src:
                return a.get("alt", "")
        return f"![{a.get('alt', '')}]({src})"
    if n.tag == "br":
        return "  \n"
    if n.tag == "hr":
        return "\n\n---\n\n"
    if n.tag == "table":
        return _table(n, media)
    if n.tag in ("ul", "ol"):
        return _list(n, media, depth)
    if re.fullmatch("h[1-6]", n.tag):
        text = "".join(t.strip() for t in _strings(n))
        return f"\n\n**{text}**\n\n" if text else "\n\n"
    inner = _children(n, media, depth)
    if n.tag in ("strong", "b"):
        return inner if n.inside("strong", "b") else _wrap("**", inner)
    if n.tag in ("em", "i"):
        return inner if n.inside("em", "i") else _wrap("*", inner)
    if n.tag == "code" and not n.inside("pre"):
        return _wrap("`", inner)
    if n.tag == "pre":
        return f"\n\n```\n{n.text().strip(chr(10))}\n```\n\n"
    if n.tag == "a" and a.get("href") and inner.strip():
        text = inner.strip()
        return f"<{text}>" if text == a["href"] else inner.replace(text, f"[{text}]({a['href']})", 1)
    if n.tag == "blockquote":
        return "\n\n" + "\n".join("> " + x for x in inner.strip().split("\n")) + "\n\n"
    return f"\n\n{inner.strip()}\n\n" if n.tag in _BLOCKS else inner


def _strings(n: _Node) -> Iterator[str]:
    for k in n.kids:
        if isinstance(k, str):
            yield k
        elif not _hidden(k):
            yield from _strings(k)


def to_markdown(html: str | None, media=None) -> str:
    """Markdown of a fragment. Headings are bold paragraphs, since a fragment's are no part of the document's; equations in images are formulas; nested emphasis counts once."""
    if not html or not html.strip():
        return ""
    if "<" not in html and "&" not in html:  # nothing to parse
        return " ".join(html.split())
    p = _Tree()
    p.feed(html)
    p.close()
    lines = [re.sub(r"^ +(?![*+\-\d])", "", x) if not x.startswith("  ") else x for x in _children(p.root, media, 0).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip(" ") + ("  " if x.endswith("  ") and x.strip() else "") for x in lines)).strip()


#: Fragments of so many characters at most are kept with their markdown, so many in a worker: tables and images of one make come again in many texts.
KEPT_CHARS, KEPT = 2000, 4096
_kept = lru_cache(KEPT)(to_markdown)


def _block(lines: list[str], tag: str) -> list[str]:
    html = "\n".join(lines)
    made = _kept(html) if len(html) <= KEPT_CHARS else to_markdown(html)
    return lines if not made.strip() or (tag == "table" and "|" not in made) else made.splitlines()


def _convert(text: str) -> str:
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        head = lines[i].lstrip()
        m = re.match(r"<(table|figure)\b", head, re.I)
        if m:
            tag, depth, end = m[1].lower(), 0, None
            for j in range(i, min(i + MOST_LINES, len(lines))):
                low = lines[j].lower()
                depth += low.count("<" + tag) - low.count(f"</{tag}>")
                if depth <= 0:
                    end = j
                    break
            if end is not None:
                out += _block(lines[i : end + 1], tag)
                i = end + 1
                continue
        elif re.match(r"<img\b[^>]*>\s*$", head, re.I):
            out += _block([lines[i]], "img")
            i += 1
            continue
        out.append(lines[i])
        i += 1
    return "\n".join(out)


def embedded(md: str) -> str:
    """Tables, figures and images of HTML that begin a line and close within 400 lines become markdown; code fences stay."""
    if not re.search("<(table|figure|img)", md, re.I):
        return md
    return "".join(x if n % 2 else _convert(x) for n, x in enumerate(_FENCED_BLOCK.split(md)))


def unescape_outside_fences(md: str) -> str:
    return "".join(x if n % 2 else _html.unescape(x) for n, x in enumerate(_FENCE.split(md)))


def _udf(rule):
    @F.pandas_udf(StringType())
    def run(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in cells:
            yield s.map(lambda x: rule(x) if isinstance(x, str) else None)

    return run


fragment_to_markdown = _udf(to_markdown)
convert_embedded = _udf(embedded)
decode_html_entities = _udf(unescape_outside_fences)
_clean = _udf(lambda x: unescape_outside_fences(embedded(x)))


def clean_text(md):
    """Embedded HTML and entities of a text; texts without either don't leave the JVM."""
    has = md.rlike(r"(?i)<(table|figure|img)|&[#a-z]")
    return F.when(has, _clean(F.when(has, md))).otherwise(md)
