"""Heading-quality passes over (doc_id, line_no, line).

Each takes lines and returns them rewritten with ``changed`` (1 or 0). A pass changes only
its own pattern. ``demote`` drops the marks and keeps the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import demote_prose, heading_emphasis, lock_depth, strip, strip_page_spans
from .lines import after, atx_heading, before, demote, forward, hash_heading, rewritten, upto, whole

SUBSTANTIVE = 80
BOOK_H1 = 3
FRONT_SHARE = 0.30
TOC_LINES = 2
INDEX_RUN = 5


def _each(rule):
    def run(lines: DataFrame) -> DataFrame:
        new = rule(F.col("line"))
        return rewritten(lines, new != F.col("line"), new)

    return run


lock_numbered_depth = _each(lock_depth)
strip_emphasis = _each(heading_emphasis)
demote_prose_headings = _each(demote_prose)


def dedupe_consecutive(lines: DataFrame) -> DataFrame:
    """Drops a heading equal to the heading before it with only blanks between, and those blanks."""
    s = strip(F.col("line"))
    df = lines.withColumn("s", s).withColumn("prev", F.last(F.when(F.col("s") != "", F.col("s")), ignorenulls=True).over(before()))
    df = df.withColumn("gone", F.col("s").startswith("#") & F.coalesce(F.col("s") == F.col("prev"), F.lit(False)))
    nxt = F.last(F.when(F.col("s") != "", F.col("gone")), ignorenulls=True).over(after())
    df = df.withColumn("next_gone", nxt)
    return df.where(~F.col("gone") & ~((F.col("s") == "") & F.coalesce("next_gone", F.lit(False)))).select("doc_id", "line_no", "line")


def demote_front_matter(lines: DataFrame) -> DataFrame:
    """Headings before a book's first chapter, when they are a minority."""
    h, level, _ = hash_heading(F.col("line"))
    df = lines.withColumn("h", h).withColumn("h1", h & (level == 1))
    first = F.min(F.when(F.col("h1"), F.col("line_no"))).over(whole())
    df = df.withColumn("first", first).withColumn("n1", F.sum(F.col("h1").cast("int")).over(whole())).withColumn("n", F.sum(F.col("h").cast("int")).over(whole()))
    df = df.withColumn("pre", F.sum((F.col("h") & (F.col("line_no") < F.col("first"))).cast("int")).over(whole()))
    ok = (F.col("n1") >= BOOK_H1) & (F.col("pre") > 0) & (F.col("pre") < F.col("n") * FRONT_SHARE)
    return rewritten(df, ok & F.col("h") & (F.col("line_no") < F.col("first")) & F.col("line").rlike(r"^\s*#{1,6}\s+"), demote(F.col("line")))


def _grouped(lines: DataFrame) -> DataFrame:
    """Adds h, level, text and the number of the heading that a line belongs to."""
    h, level, text = hash_heading(F.col("line"))
    return lines.withColumn("h", h).withColumn("level", level).withColumn("text", strip(text)).withColumn("grp", F.sum(h.cast("int")).over(upto()))


def demote_toc_outline(lines: DataFrame) -> DataFrame:
    """A book's chapter labels that stand above lines of a table of contents."""
    df = _grouped(lines)
    toc = F.sum((~F.col("h") & F.col("line").rlike(r"^\s*-\s+\d+\.\d+[a-z]?\s+\S.*?\d{1,4}\s*$")).cast("int")).over(Window.partitionBy("doc_id", "grp"))
    df = df.withColumn("toc", toc).withColumn("n1", F.sum((F.col("h") & (F.col("level") == 1)).cast("int")).over(whole()))
    return rewritten(df, F.col("h") & (F.col("n1") >= BOOK_H1) & (F.col("toc") >= TOC_LINES), demote(F.col("line")))


def toc_key(text):
    core = F.regexp_replace(strip(F.regexp_replace(text, r"\s+\d{1,4}\s*$", "")), r"^\d+(?:\.\d+)*\.?\s+", "")
    return F.replace(F.lower(strip(F.regexp_replace(core, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def demote_toc_phantoms(lines: DataFrame) -> DataFrame:
    """Headings that end in a page number and have a twin without one in the document."""
    h, _, text = hash_heading(F.col("line"))
    df = lines.withColumn("h", h).withColumn("text", text).withColumn("key", toc_key(text)).withColumn("page", text.rlike(r"\s+\d{1,4}\s*$"))
    twin = F.max((F.col("h") & ~F.col("page") & (F.col("key") != "")).cast("int")).over(Window.partitionBy("doc_id", "key"))
    indent = F.regexp_extract(F.col("line"), r"^\s*", 0)
    return rewritten(df.withColumn("twin", twin), F.col("h") & F.col("page") & (F.col("key") != "") & (F.col("twin") == 1), F.concat(indent, F.col("text")))


def demote_empty_shells(lines: DataFrame) -> DataFrame:
    """Headings directly above a heading of the same or a higher rank."""
    h, level, _ = atx_heading(F.col("line"))
    df = lines.withColumn("h", h).withColumn("level", F.when(h, level))
    nxt = F.last(F.when(strip(F.col("line")) != "", F.struct("level")), ignorenulls=True).over(after())
    df = df.withColumn("next_level", nxt["level"])
    return rewritten(df, F.col("h") & F.coalesce(F.col("next_level") <= F.col("level"), F.lit(False)), F.regexp_replace(F.col("line"), r"^(\s*)#{1,6}\s+(\S.*?)\s*$", "$1$2"))


def demote_scaffold(lines: DataFrame) -> DataFrame:
    """Heading texts of three or more occurrences, of which at most one has a body: the empty ones."""
    df = _grouped(lines)
    df = df.withColumn("size", F.sum(F.when(~F.col("h"), F.length(F.regexp_replace(F.col("line"), r"\s+", ""))).otherwise(0)).over(Window.partitionBy("doc_id", "grp")))
    w = Window.partitionBy("doc_id", "h", "text")
    sub = (F.col("size") > SUBSTANTIVE).cast("int")
    df = df.withColumn("n", F.count("*").over(w)).withColumn("real", F.sum(sub).over(w))
    return rewritten(df, F.col("h") & (F.col("n") >= 3) & ((F.col("real") == 0) | ((F.col("real") == 1) & (F.col("size") <= SUBSTANTIVE))), demote(F.col("line"), "#+"))


def _listish(heading: str, plain: str):
    def run(lines: DataFrame) -> DataFrame:
        line = F.col("line")
        df = lines.withColumn("h", line.rlike(heading)).withColumn("nh", F.sum(line.rlike(heading).cast("int")).over(whole())).withColumn("np", F.sum(line.rlike(plain).cast("int")).over(whole()))
        return rewritten(df, F.col("h") & (F.col("np") > F.col("nh")), F.regexp_replace(line, heading, "$1$2"))

    return run


demote_bare_int = _listish(r"^(\s*)#{1,6}\s+(\d+\s+\S.*?)\s*$", r"^\s*\d+\s+\S")
demote_dotted_int = _listish(r"^(\s*)#{1,6}\s+(\d+\.\s+\S.*?)\s*$", r"^\s*\d+\.\s+\S")


def demote_fragments(lines: DataFrame) -> DataFrame:
    """Short headings of the deepest level without a body, but for runs of five (an index)."""
    line = F.col("line")
    s = strip(line)
    p = r"^(#{1,6})\s+(.+?)\s*$"
    df = lines.withColumn("h", s.rlike(p)).withColumn("level", F.length(F.regexp_extract(s, p, 1)))
    df = df.withColumn("text", strip(F.regexp_replace(strip_page_spans(F.regexp_extract(s, p, 2)), r"\s+", " ")))
    deepest = F.max(F.when(F.col("h"), F.col("level"))).over(whole())
    least = F.min(F.when(F.col("h"), F.col("level"))).over(whole())
    df = df.withColumn("deepest", deepest).withColumn("least", least).withColumn("grp", F.sum(F.col("h").cast("int")).over(upto()))
    body = strip(strip_page_spans(line))
    is_body = (body != "") & ~F.col("h") & ~body.rlike(r"^\s*!\[[^\]]*\]\([^)]+\)\s*$") & body.rlike(r"(?U)\w")
    df = df.withColumn("body", F.max(is_body.cast("int")).over(Window.partitionBy("doc_id", "grp")))
    df = df.withColumn("frag", F.col("h") & (F.col("level") == F.col("deepest")) & ((F.length("text") <= 3) | ~F.col("text").rlike(r"(?U)\w")))
    # Runs over consecutive headings: a fragment's run is the number of non-fragment headings before it.
    df = df.withColumn("run", F.sum((F.col("h") & ~F.col("frag")).cast("int")).over(upto()))
    df = df.withColumn("size", F.sum(F.col("frag").cast("int")).over(Window.partitionBy("doc_id", "run")))
    to = F.concat(F.regexp_extract(line, r"^(\s*)#{1,6}\s+(.*)$", 1), strip(strip_page_spans(F.regexp_extract(line, r"^(\s*)#{1,6}\s+(.*)$", 2))))
    return rewritten(df, F.col("frag") & (F.col("deepest") > F.col("least")) & (F.col("body") == 0) & (F.col("size") < INDEX_RUN), to)


#: In the order in which a document goes through them.
PASSES = (
    lock_numbered_depth, strip_emphasis, demote_prose_headings, demote_front_matter, demote_toc_outline, demote_toc_phantoms,
    demote_empty_shells, demote_scaffold, demote_bare_int, demote_dotted_int, demote_fragments,
)


def heading_passes(lines: DataFrame) -> DataFrame:
    """All passes in order."""
    df = lines.select("doc_id", "line_no", "line")
    for rule in PASSES:
        df = rule(df).drop("changed")
    return df


def outline_passes(lines: DataFrame) -> DataFrame:
    """The passes for documents whose headings were made from an outline, which are trusted: none that judges their wording or place."""
    df = lines.select("doc_id", "line_no", "line")
    for rule in (lock_numbered_depth, strip_emphasis, demote_toc_phantoms, demote_scaffold):
        df = rule(df).drop("changed")
    return df
