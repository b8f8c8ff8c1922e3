"""Repair of heading slips, and structure passes, over (doc_id, line_no, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .lines import atx_heading, before, each_line, rewritten, upto, whole

FLAT_RUN = 5
ORPHAN_PERCENT = 70
_P = r"^(\s*)(#{1,6})\s+(\S.*?)\s*$"


def _parts(line):
    return F.regexp_extract(line, _P, 1), F.regexp_extract(line, _P, 2), F.regexp_extract(line, _P, 3)


@each_line
def strip_heading_spans(line):
    lead, marks, text = _parts(line)
    clean = strip(F.regexp_replace(text, r"</?span[^>]*>", ""))
    return ((text != "") & (clean != "") & (clean != text), F.concat(lead, marks, F.lit(" "), clean))


@each_line
def demote_number_only(line):
    lead, _, text = _parts(line)
    return (text.rlike(r"^\d+$"), F.concat(lead, text))


@each_line
def dedupe_doubled(line):
    lead, marks, text = _parts(line)
    half = F.regexp_extract(text, r"^(.+?)\s+\1$", 1)
    return (F.length(strip(half)) >= 2, F.concat(lead, marks, F.lit(" "), half))


@each_line
def demote_spaced_letters(line):
    lead, _, text = _parts(line)
    tokens = F.split(text, r"\s+")
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    return ((text != "") & (single >= 4) & (single / F.size(tokens) >= 0.6), F.concat(lead, text))


def ancestors(level, order: str = "line_no"):
    """Struct of the positions of the last heading of each level before this row, for the stack of open headings."""
    return [F.last(F.when(level == k, F.col(order)), ignorenulls=True).over(before()) for k in range(1, 7)]


def close_level_gaps(lines: DataFrame) -> DataFrame:
    """No heading more than one level below its parent; headings in fences don't count.

    The open headings above a heading are the last of each level that no higher rank has closed
    since; the clamp runs along them.
    """
    line = F.col("line")
    mark = F.regexp_extract(line, r"^\s*(`{3,}|~{3,})", 1)
    # A fence ends at the next fence of its own kind, so the state is folded over the marks of a document.
    df = lines.withColumn("m", F.when(mark != "", F.substring(mark, 1, 1)))
    marks = df.where("m is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "m"))).alias("ms"))
    state = F.aggregate(
        "ms", F.struct(F.lit("").alias("open"), F.array().cast("array<struct<line_no:bigint,open:string>>").alias("out")),
        lambda a, x: F.struct(
            F.when(a["open"] == "", x["m"]).when(a["open"] == x["m"], F.lit("")).otherwise(a["open"]).alias("open"),
            F.concat(a["out"], F.array(F.struct(x["line_no"].alias("line_no"), F.when(a["open"] == "", x["m"]).when(a["open"] == x["m"], F.lit("")).otherwise(a["open"]).alias("open")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    opened = marks.select("doc_id", F.explode(state).alias("s")).select("doc_id", F.col("s.line_no").alias("line_no"), F.col("s.open").alias("open"))
    df = df.join(opened, ["doc_id", "line_no"], "left")
    fenced = F.coalesce(F.last("open", ignorenulls=True).over(upto()), F.lit("")) != ""
    h, level, text = atx_heading(line)
    df = df.withColumn("h", h & ~(fenced | F.col("m").isNotNull())).withColumn("level", F.when(F.col("h"), level)).withColumn("text", text)
    for k, c in enumerate(ancestors(F.col("level")), 1):
        df = df.withColumn(f"p{k}", c)
    # Ancestors on the stack: level k is open if nothing of a lower number came after it.
    stack = F.filter(
        F.array(*[F.when((F.col(f"p{k}").isNotNull()) & (F.lit(k) < F.col("level")) & F.expr(" and ".join([f"coalesce(p{k} > p{j}, true)" for j in range(1, k)]) or "true"), F.lit(k)) for k in range(1, 7)]),
        lambda x: x.isNotNull(),
    )
    new = F.aggregate(F.concat(stack, F.array("level")), F.lit(0), lambda a, x: F.when(a == 0, x).otherwise(F.least(x, a + 1)))
    df = df.withColumn("new", F.when(F.col("h"), new))
    return rewritten(df, F.col("h") & (F.col("new") != F.col("level")), F.concat(F.regexp_extract(line, _P, 1), F.repeat(F.lit("#"), F.col("new")), F.lit(" "), F.col("text")))


def repair_headings(lines: DataFrame) -> DataFrame:
    from .headings import lock_numbered_depth

    df = lines
    for rule in (lock_numbered_depth, strip_heading_spans, demote_number_only, dedupe_doubled, demote_spaced_letters, close_level_gaps):
        df = rule(df).drop("changed")
    return df


def nest_enumerated(lines: DataFrame) -> DataFrame:
    """Runs of first-level headings that end in a number in brackets go one level down, with what they own."""
    line = F.col("line")
    p = r"^(#{1,6})\s+(.*?)\s*$"
    h, level, text = line.rlike(p), F.length(F.regexp_extract(line, p, 1)), F.regexp_extract(line, p, 2)
    enum = text.rlike(r"(?i)\(\s*(?:step\s+)?\d+(?:\.\d+)?\s*\)\s*$")
    df = lines.withColumn("h", h).withColumn("level", level).withColumn("kind", F.when(h & (level == 1), enum.cast("int")))
    df = df.withColumn("state", F.last("kind", ignorenulls=True).over(upto())).withColumn("seen", F.max(F.when(F.col("kind") == 0, 1)).over(upto()))
    return rewritten(df, F.col("h") & (F.col("level") < 6) & (F.col("state") == 1) & (F.col("seen") == 1), F.concat(F.lit("#"), line))


def demote_flat_runs(lines: DataFrame, threshold: int = FLAT_RUN) -> DataFrame:
    """Of five or more first-level headings in a row all but the first go one level down."""
    line = F.col("line")
    h = line.rlike(r"^#{1,6}\s+\S")
    one = line.rlike(r"^#\s+\S")
    df = lines.withColumn("one", one).withColumn("run", F.sum((h & ~one).cast("int")).over(upto()))
    w = Window.partitionBy("doc_id", "run")
    df = df.withColumn("size", F.sum(F.col("one").cast("int")).over(w)).withColumn("nth", F.sum(F.col("one").cast("int")).over(w.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    return rewritten(df, F.col("one") & (F.col("size") >= threshold) & (F.col("nth") > 1), F.concat(F.lit("#"), line))


def rebalance_orphans(lines: DataFrame, percent: int = ORPHAN_PERCENT) -> DataFrame:
    """First-level headings without a heading of their own go down when most of them are like that; the first stays."""
    line = F.col("line")
    h = line.rlike(r"^#{1,6}\s+\S")
    one = line.rlike(r"^#\s+\S")
    df = lines.withColumn("one", one).withColumn("sub", h & ~one).withColumn("grp", F.sum(one.cast("int")).over(upto()))
    df = df.withColumn("child", F.max(F.col("sub").cast("int")).over(Window.partitionBy("doc_id", "grp")))
    orphan = F.col("one") & (F.col("grp") > 1) & (F.col("child") == 0)
    df = df.withColumn("orphans", F.sum(orphan.cast("int")).over(whole())).withColumn("ones", F.sum(F.col("one").cast("int")).over(whole()))
    fire = (F.col("ones") >= 2) & (F.floor(F.col("orphans") * 100 / (F.col("ones") - 1)) >= percent)
    return rewritten(df, orphan & fire, F.concat(F.lit("#"), line))
