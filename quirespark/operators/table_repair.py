"""Tables that an extraction broke, put right from a second extraction of their page.

Broken tables are those with a cell of very many joined lines, and those with a row per wrapped
line. Each is compared with the tables of its candidate pages by the words both hold; the
second extraction comes in as rows (doc_id, page, block, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .lines import upto

MEGA, OVERLAP, PAGES = 30, 0.5, 12
BIGRAMS, PRESERVED = 4, 0.5
BR = r"(?i)<br\s*/?>"


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line, text) of the tables outside code fences."""
    fence = F.regexp_replace("line", r"^\s+", "").startswith("```").cast("int")
    df = lines.select("doc_id", "line_no", "line", fence.alias("f")).withColumn("inside", (F.col("f") == 1) | (F.sum("f").over(upto()) % 2 == 1))
    df = df.withColumn("t", ~F.col("inside") & strip(F.col("line")).startswith("|")).withColumn("run", F.sum((~F.col("t")).cast("int")).over(upto())).where("t")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return df.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), text.alias("text")).drop("run")


def _cells(line: Column) -> Column:
    return F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|", -1)


def _breaks(c: Column) -> Column:
    return F.regexp_count(c, F.lit(BR))


def collapsed_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, first_line, line_no, cell, br_count): lines whose worst cell joins 30 lines or more."""
    df = tables.select("doc_id", "first_line", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    cells = F.transform(_cells(F.col("line")), lambda c, i: F.struct(_breaks(c).alias("n"), (-i).alias("i"), strip(c).alias("cell")))
    df = df.withColumn("worst", F.array_max(cells)).where(F.col("worst.n") >= MEGA)
    return df.select("doc_id", "first_line", (F.col("first_line") + F.col("i")).alias("line_no"), F.col("worst.cell").alias("cell"), F.col("worst.n").alias("br_count"))


def split_tables(tables: DataFrame) -> DataFrame:
    """Tables with a row that goes on the one above: only its first cell, or all but its first, is filled."""
    rows = F.transform(F.slice(F.split("text", "\n"), F.lit(2), F.size(F.split("text", "\n"))), lambda x: F.transform(_cells(x), lambda c: strip(c)))
    rest = lambda r: F.exists(F.slice(r, F.lit(2), F.size(r)), lambda c: c != "")
    return tables.where(F.exists(rows, lambda r: (F.size(r) >= 2) & ((F.element_at(r, 1) == "") == rest(r))))


def tokens(text: Column) -> Column:
    """Words of two characters or more, lower case, in order."""
    return F.filter(F.transform(F.regexp_extract_all(F.regexp_replace(text, BR, " "), F.lit(r"([A-Za-z0-9.]+)"), 1), lambda t: F.lower(t)), lambda t: F.length(t) > 1)


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbours. The words are bound once; as a plain expression they would be made anew for every pair."""

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.array_distinct(pairs(w))).otherwise(F.array().cast("array<string>")))
    return F.element_at(bound, 1)


def cell_values(text: Column) -> Column:
    """Values of a table's cells, dividers left out, or of a cell's joined lines."""

    def of(x: Column) -> Column:
        s = strip(x)
        own = F.filter(F.transform(_cells(s), lambda c: strip(c)), lambda c: (c != "") & ~F.contains(c, F.lit("---")))
        return F.when(s.startswith("|"), own).when(s.rlike(BR), F.filter(F.transform(F.split(s, BR), lambda c: strip(c)), lambda c: c != "")).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(text, "\n"), of))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of one that the other has; words come as sets."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def drops_content(values: Column, other: Column) -> Column:
    """Whether a value of four word pairs or more has lost most of them; values as bigrams each, the other as bigrams."""
    return F.exists(values, lambda v: (F.size(v) >= BIGRAMS) & (F.size(F.array_intersect(v, other)) < PRESERVED * F.size(v)))


def snippet(text: Column) -> Column:
    """The longest joined line of six characters or more, 48 characters of it: what to look for on the pages."""
    parts = F.filter(F.transform(F.split(text, BR), lambda s: strip(s)), lambda s: F.length(s) >= 6)
    return F.substring(_longest(parts), 1, 48)


def table_snippet(text: Column) -> Column:
    """The same for a table: its longest cell of eight characters or more."""
    cells = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.transform(_cells(x), lambda c: strip(c))))
    return F.substring(_longest(F.filter(cells, lambda c: (F.length(c) >= 8) & ~F.contains(c, F.lit("---")))), 1, 48)


def _longest(parts: Column) -> Column:
    return F.array_max(F.transform(parts, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]


def locate(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(…, page) of the first twelve pages (doc_id, page, text) of a document that hold the snippet of (doc_id, first_line, snippet)."""
    df = wanted.join(pages.select("doc_id", "page", F.col("text").alias("page_text")), "doc_id").where(F.contains("page_text", F.col("snippet")))
    w = Window.partitionBy("doc_id", "first_line").orderBy("page")
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= PAGES).drop("rn", "page_text")


def best_match(broken: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, first_line, page, match, score): for each broken table (doc_id, first_line, page, text) the table (doc_id, page, block, text) of its pages that shares most words both ways, a half at least, that is not broken itself and drops no content; of equals the first page's and block's."""
    b = broken.select("doc_id", "first_line", "page", F.array_distinct(tokens(F.col("text"))).alias("bt"), F.transform(cell_values(F.col("text")), lambda v: bigrams(tokens(v))).alias("bv"))
    c = candidates.where(~F.exists(F.split("text", r"\|"), lambda x: _breaks(x) >= MEGA)).select("doc_id", "page", "block", F.col("text").alias("match"), F.array_distinct(tokens(F.col("text"))).alias("ct"), bigrams(tokens(F.col("text"))).alias("cb"))
    score = F.least(overlap(F.col("bt"), F.col("ct")), overlap(F.col("ct"), F.col("bt")))
    df = b.join(c, ["doc_id", "page"]).where(~drops_content(F.col("bv"), F.col("cb"))).withColumn("score", score).where(F.col("score") >= OVERLAP)
    best = df.groupBy("doc_id", "first_line").agg(F.min(F.struct((-F.col("score")).alias("s"), "page", "block", "match")).alias("x"))
    return best.select("doc_id", "first_line", "x.page", "x.match", (-F.col("x.s")).alias("score"))


def splice(lines: DataFrame, tables: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, line_no, part, line): the lines with the found tables in the place of the broken ones."""
    spans = found.join(tables.select("doc_id", "first_line", "last_line"), ["doc_id", "first_line"]).select("doc_id", F.col("first_line").alias("line_no"), F.col("last_line").alias("to"), "match")
    df = lines.select("doc_id", "line_no", "line").join(spans, ["doc_id", "line_no"], "left").withColumn("end", F.last("to", ignorenulls=True).over(upto()))
    own = F.when(F.col("match").isNotNull(), F.split("match", "\n")).when(F.col("line_no") <= F.col("end"), F.array().cast("array<string>")).otherwise(F.array("line"))
    return df.select("doc_id", "line_no", F.posexplode(own).alias("part", "line"))


def repair(lines: DataFrame, page_texts: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines with broken tables replaced, and a record (doc_id, line, br_count, page, status) of each: repaired, no-match or no-page."""
    tables = blocks(lines)
    mega = collapsed_cells(tables).select("doc_id", "first_line", "line_no", "br_count", F.col("cell").alias("text"), snippet(F.col("cell")).alias("snippet"))
    broken = split_tables(tables).join(mega.select("doc_id", "first_line").distinct(), ["doc_id", "first_line"], "left_anti")
    torn = broken.select("doc_id", "first_line", F.col("first_line").alias("line_no"), F.lit(0).alias("br_count"), "text", table_snippet(F.col("text")).alias("snippet"))
    wanted = mega.unionByName(torn)
    placed = locate(wanted, page_texts)
    found = best_match(placed, candidates)
    first = placed.groupBy("doc_id", "line_no").agg(F.min("page").alias("page0"))
    rec = wanted.select("doc_id", "first_line", "line_no", "br_count").join(first, ["doc_id", "line_no"], "left").join(found.select("doc_id", "first_line", F.col("page").alias("page1")), ["doc_id", "first_line"], "left")
    status = F.when(F.col("page0").isNull(), "no-page").when(F.col("page1").isNull(), "no-match").otherwise("repaired")
    records = rec.select("doc_id", (F.col("line_no") + 1).alias("line"), "br_count", F.when(F.col("page0").isNotNull(), F.coalesce("page1", "page0")).alias("page"), status.alias("status"))
    return splice(lines, tables, found), records
