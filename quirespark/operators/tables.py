"""Pipe tables as blocks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .lines import upto

DIVIDER = r"^\s*\|?\s*:?-{2,}.*\|?\s*$"
OVERLAP = 0.5


def cells_of(line: Column) -> Column:
    """Trimmed cells of a table line, without the outer bars and the empty cells at its end."""
    cells = F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|", -1), lambda c: strip(c))
    last = F.coalesce(F.array_max(F.transform(cells, lambda c, i: F.when(c != "", i + 1))), F.lit(0))
    return F.slice(cells, F.lit(1), last)


def table_lines(lines: DataFrame, closed: bool = False) -> DataFrame:
    """Lines of tables with ``block``, a number per run of lines that begin with a bar (and end with one, if ``closed``)."""
    s = strip(F.col("line"))
    table = s.startswith("|") & s.endswith("|") if closed else s.startswith("|")
    df = lines.select("doc_id", "line_no", "line", table.alias("t")).withColumn("block", F.sum((~F.col("t")).cast("int")).over(upto()))
    return df.where("t").select("doc_id", "block", "line_no", "line", cells_of(F.col("line")).alias("cells"), s.rlike(DIVIDER).alias("divider"))


def table_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line, n_rows, n_cols) of every table; rows without dividers."""
    return table_lines(lines).groupBy("doc_id", "block").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum((~F.col("divider")).cast("int")).alias("n_rows"), F.max(F.size("cells")).alias("n_cols"),
    ).drop("block")


def normalize_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, part, line) of the tables' lines.

    A row of one cell above a divider and a row of several is the table's caption, in bold and with
    a blank line below. Rows are as wide as the widest, two cells at least; dividers are uniform,
    and a table without one gets it below its first row (part 1).
    """
    w = Window.partitionBy("doc_id", "block")
    filled = F.size(F.filter("cells", lambda c: c != ""))
    df = table_lines(lines, closed=True).withColumn("rn", F.row_number().over(w.orderBy("line_no")))
    one = lambda n, c: F.max(F.when(F.col("rn") == n, c)).over(w)
    df = df.withColumn("titled", F.coalesce((one(1, filled) == 1) & one(2, F.col("divider")) & (one(3, filled) > 1), F.lit(False)))
    df = df.withColumn("body", ~F.col("titled") | (F.col("rn") > 2))
    width = F.greatest(F.max(F.when(F.col("body") & ~F.col("divider"), F.size("cells"))).over(w), F.lit(2))
    df = df.withColumn("width", width).withColumn("has", F.max((F.col("body") & F.col("divider")).cast("int")).over(w))
    df = df.withColumn("width", F.when(F.max((F.col("body") & ~F.col("divider")).cast("int")).over(w) == 1, F.col("width")))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = row(F.array_repeat(F.lit("---"), F.col("width")))
    padded = row(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("cells"), F.lit(0)))))
    part = lambda n, c: F.struct(F.lit(n).alias("part"), c.alias("line"))
    title = F.concat(F.lit("**"), F.element_at(F.filter("cells", lambda c: c != ""), 1), F.lit("**"))
    parts = (
        F.when(F.col("titled") & (F.col("rn") == 1), F.array(part(0, title), part(1, F.lit("")))).when(~F.col("body"), F.array().cast("array<struct<part:int,line:string>>"))
        .when(F.col("width").isNull(), F.array(part(0, F.col("line")))).when(F.col("divider"), F.array(part(0, rule)))
        .when((F.col("has") == 0) & (F.col("rn") == F.when(F.col("titled"), 3).otherwise(1)), F.array(part(0, padded), part(1, rule))).otherwise(F.array(part(0, padded)))
    )
    return df.select("doc_id", "line_no", F.explode(parts).alias("x")).select("doc_id", "line_no", "x.part", "x.line")


def match_tables(broken: DataFrame, whole: DataFrame) -> DataFrame:
    """For each broken table (doc_id, page, id, tokens) the table of the same page that shares most of its tokens, from half on: (doc_id, id, match_id, overlap)."""
    b, o = broken.alias("b"), whole.alias("o")
    both = F.size(F.array_intersect("b.tokens", "o.tokens"))
    share = both / F.least(F.size("b.tokens"), F.size("o.tokens"))
    pairs = b.join(o, (F.col("b.doc_id") == F.col("o.doc_id")) & (F.col("b.page") == F.col("o.page"))).select("b.doc_id", "b.id", F.col("o.id").alias("match_id"), share.alias("overlap")).where(F.col("overlap") >= OVERLAP)
    best = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.col("overlap").desc(), "match_id")))
    return best.where("rn = 1").drop("rn")
