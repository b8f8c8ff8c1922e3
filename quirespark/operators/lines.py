"""Documents as lines, and the window shapes that the passes are made of.

A document's lines stay together in one partition for every pass, so a chain of passes
costs one exchange. No frame looks ahead without bound: what comes next is found by
running the same window backwards, which Spark evaluates in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_lines, strip


def explode_lines(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """(doc_id, line_no, line) of every document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split_lines(F.col(md_col))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def collect_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, md): the lines joined again."""
    pairs = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("md"))


def forward() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def upto() -> Window:
    return forward().rowsBetween(Window.unboundedPreceding, 0)


def before() -> Window:
    return forward().rowsBetween(Window.unboundedPreceding, -1)


def after() -> Window:
    return Window.partitionBy("doc_id").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, -1)


def whole() -> Window:
    return Window.partitionBy("doc_id")


def hash_heading(line: Column) -> tuple[Column, Column, Column]:
    """(is heading, level, text) where no space is needed behind the marks and levels are not capped."""
    s = strip(line)
    p = r"^(#+)\s*(.+?)$"
    return s.rlike(r"^#."), F.length(F.regexp_extract(s, p, 1)), F.regexp_extract(s, p, 2)


def atx_heading(line: Column, indented: bool = True) -> tuple[Column, Column, Column]:
    """(is heading, level, text) of one to six marks and a space."""
    lead = r"\s*" if indented else ""
    p = rf"^{lead}(#{{1,6}})\s+(\S.*?)\s*$"
    return line.rlike(p), F.length(F.regexp_extract(line, p, 1)), F.regexp_extract(line, p, 2)


def demote(line: Column, marks: str = "#{1,6}") -> Column:
    """The line without heading marks; indent and text stay."""
    return F.regexp_replace(line, rf"^(\s*){marks}\s+(.*)$", "$1$2")


def rewritten(df: DataFrame, when: Column, to: Column) -> DataFrame:
    return df.select("doc_id", "line_no", F.when(when, to).otherwise(F.col("line")).alias("line"), F.coalesce(when, F.lit(False)).cast("int").alias("changed"))


def each_line(rule):
    """A pass made of a rule line -> (when, new line). The line is bound once, so that a chain of passes grows by their sum and not by their product."""

    def run(lines: DataFrame) -> DataFrame:
        def one(x: Column) -> Column:
            when, to = rule(x)
            return F.struct(F.when(when, to).otherwise(x).alias("line"), F.coalesce(when, F.lit(False)).cast("int").alias("changed"))

        return lines.select("doc_id", "line_no", F.element_at(F.transform(F.array("line"), one), 1).alias("x")).select("doc_id", "line_no", "x.line", "x.changed")

    run.__name__ = rule.__name__
    return run


def fence_flags(lines: DataFrame) -> DataFrame:
    """Adds ``fenced``: inside a code fence, its delimiters included (1 or 0)."""
    mark = strip(F.col("line")).rlike(r"^(```|~~~)").cast("int")
    return lines.withColumn("fenced", F.greatest(mark, F.sum(mark).over(upto()) % 2).cast("int"))


def squeeze_blanks(lines: DataFrame) -> DataFrame:
    """At most one blank line in a row."""
    blank = strip(F.col("line")) == ""
    return lines.withColumn("p", F.lag(blank).over(forward())).where(~(blank & F.coalesce("p", F.lit(False)))).drop("p")
