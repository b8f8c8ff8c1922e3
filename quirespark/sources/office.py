"""Office files to markdown: word processor documents, sheets of separated values, and the media inside archives.

The files are archives of XML, which the standard library reads; a file at a time in Arrow batches.
A file that can't be read has a null text and the reason as its status, and breaks nothing.
"""

from __future__ import annotations

import csv
import io
import zipfile
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp", ".svg", ".emf", ".wmf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _runs(p, rels: dict[str, str]) -> str:
    """Text of a paragraph; neighbouring runs of one weight and slant are one, images are references."""
    parts: list[tuple[bool, bool, str]] = []
    for r in p.iter(f"{_W}r"):
        style = r.find(f"{_W}rPr")
        on = lambda tag: style is not None and (x := style.find(_W + tag)) is not None and x.get(f"{_W}val") not in ("0", "false")  # noqa: B023, E731
        text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in r)
        for blip in r.iter():
            if (target := rels.get(blip.get(f"{_REL}embed", ""))) is not None:
                text += f"![](images/{target.rpartition('/')[2]})"
        if text:
            parts.append((on("b"), on("i"), text))
    out = []
    for (bold, slanted), same in groupby(parts, key=lambda x: x[:2]):
        text = "".join(t for *_, t in same)
        mark = "**" * bold + "*" * slanted
        core = text.strip()
        out.append(text.replace(core, f"{mark}{core}{mark[::-1]}", 1) if mark and core else text)
    return "".join(out).strip()


def _table(t, rels: dict[str, str]) -> list[str]:
    rows = [["<br>".join(x for p in c.iter(f"{_W}p") if (x := _runs(p, rels))).replace("|", "\\|").replace("\n", " ") for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
    width = max(map(len, rows), default=0)
    if not width:
        return []
    line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
    return ["", line(rows[0]), line(["---"] * width), *map(line, rows[1:]), ""]


def document_to_markdown(content: bytes) -> str:
    """Headings by their styles, lists by their depth, tables and text in their order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        links = "word/_rels/document.xml.rels"
        rels = {r.get("Id", ""): r.get("Target", "") for r in ElementTree.fromstring(z.read(links))} if links in z.namelist() else {}
    out: list[str] = []
    for x in body if body is not None else ():
        if x.tag == f"{_W}tbl":
            out += _table(x, rels)
        elif x.tag == f"{_W}p" and (text := _runs(x, rels)):
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower().replace(" ", "") if style is not None else ""
            depth = x.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
            if name == "title":
                out += [f"# {text.replace('*', '')}", ""]
            elif name.startswith("heading") and name[7:].isdigit():
                out += ["#" * min(int(name[7:]), 6) + " " + text.replace("*", ""), ""]
            elif x.find(f"{_W}pPr/{_W}numPr") is not None:
                out.append("  " * int(depth.get(f"{_W}val") or 0 if depth is not None else 0) + "- " + text)
            else:
                out += [text, ""]
    return "\n".join(out).strip() + "\n" if any(out) else ""


def sheet_to_markdown(content: bytes) -> str:
    """A table of separated values; its first row is the head."""
    rows = [[c.replace("|", "\\|").replace("\n", " ").strip() for c in r] for r in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline="")) if r]
    width = max(map(len, rows), default=0)
    line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) + "\n" if rows else ""


READERS = {"docx": document_to_markdown, "csv": sheet_to_markdown}


def read_office(files: DataFrame) -> DataFrame:
    """(doc_id, md, status) of files (doc_id, suffix, content); the status is ``ok``, ``unsupported`` or what went wrong."""

    def run(batches):
        for b in batches:
            rows = []
            for d, suffix, content in zip(b["doc_id"], b["suffix"], b["content"]):
                reader = READERS.get(suffix)
                try:
                    rows.append((d, reader(content), "ok") if reader and content is not None else (d, None, "unsupported"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, csv.Error) as e:
                    rows.append((d, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "md", "status"])

    return files.select("doc_id", "suffix", "content").mapInPandas(run, "doc_id bigint, md string, status string")


def media(files: DataFrame) -> DataFrame:
    """(doc_id, name, data): images inside archives (doc_id, content), by base name; what is no archive has none."""

    def run(batches):
        for b in batches:
            rows = []
            for d, content in zip(b["doc_id"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        rows += [(d, n.rpartition("/")[2], z.read(n)) for n in z.namelist() if n.lower().endswith(IMAGES)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "name", "data"])

    return files.select("doc_id", F.col("content").cast("binary").alias("content")).mapInPandas(run, "doc_id bigint, name string, data binary")
