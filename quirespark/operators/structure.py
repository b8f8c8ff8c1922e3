"""Whole-document rewrites: outlines, contents, template pages, embedded HTML, the clean-up as one chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fragments, refs
from ..functions.text import clean_line, collapse_emphasis, is_image_only, slug, strip
from ..session import checkpointed
from . import headings, links, tables
from .lines import collect_lines, explode_lines, squeeze_blanks, upto, whole

OUTLINE_LINE = r"^((?:[*+\-]\s+)*)(\s*)(\d+)\.\s+(\S.*)$"
ATX = r"^(#{1,6})\s+\S"
OUTLINE_HEADINGS = 2
TOC = r"(?i)^\s*#+\s*Table of Contents\s*$"
TOC_HEADING = r"^(#{1,4})\s+(.+?)\s*$"
TEMPLATE = (
    r"\(#_Toc\d+\)", r"(?i)\|\s*Date\s*\|\s*Version\s*\|\s*Description\s*\|\s*Author\s*\|", r"<(?:Project Name|Month|Year|#\.#)>", r"\bDelete all [Ii]nstructional [Tt]ext\b",
    r"\bPlace latest revisions at top of table\b", r"\bArtifact Rationale\b", r"\bRemove blank rows\b",
)


def template_patterns(text: Column) -> Column:
    """How many of the marks of a template's first pages a text has."""
    return sum((text.rlike(p).cast("int") for p in TEMPLATE), F.lit(0))


def strip_template_pages(md: Column) -> Column:
    """The text from its first heading of the first level on, if what is before has two marks of a template or more."""
    at = F.regexp_instr(md, F.lit(r"(?m)^#\s+\S"))
    return F.when((at > 1) & (template_patterns(F.substring(md, F.lit(1), at - 1)) >= 2), F.substring(md, at, F.length(md))).otherwise(md)


def regenerate_toc(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, part, line): the lines from the contents' heading to the next heading become a list of the headings of levels 1 to 4 that follow, indented from the shallowest."""
    line = F.col("line")
    df = lines.select("doc_id", "line_no", "line").withColumn("toc", F.min(F.when(line.rlike(TOC), F.col("line_no"))).over(whole()))
    df = df.withColumn("next", F.min(F.when((F.col("line_no") > F.col("toc")) & line.rlike(TOC_HEADING), F.col("line_no"))).over(whole()))
    title = strip(F.regexp_replace(strip(F.regexp_extract("line", TOC_HEADING, 2)), r"\*+$", ""))
    entry = F.coalesce((F.col("line_no") >= F.col("next")) & line.rlike(TOC_HEADING) & ~line.rlike(TOC) & (title != ""), F.lit(False))
    df = df.withColumn("entry", entry).withColumn("depth", F.when(F.col("entry"), F.length(F.regexp_extract("line", TOC_HEADING, 1)))).withColumn("least", F.min("depth").over(whole()))
    df = df.withColumn("nth", F.sum(F.col("entry").cast("int")).over(upto())).withColumn("n", F.sum(F.col("entry").cast("int")).over(whole()))
    label = F.when(slug(line) != "", F.concat(F.lit("["), title, F.lit("](#"), slug(line), F.lit(")"))).otherwise(title)
    bullet = F.concat(F.repeat(F.lit("  "), F.col("depth") - F.col("least")), F.lit("- "), label)
    # A heading brings its entry to the contents' place itself, so that no row holds the list of them all.
    at = lambda no, part, text: F.struct(no.alias("line_no"), part.cast("int").alias("part"), text.alias("line"))
    own, toc = at(F.col("line_no"), F.lit(0), line), F.col("toc")
    block = F.array(at(toc, F.lit(0), F.lit("## Table of Contents")), at(toc, F.lit(1), F.lit("")))
    rows = (
        F.when(F.col("line_no") == toc, F.when(F.col("n") > 0, F.concat(block, F.array(at(toc, F.col("n") + 2, F.lit(""))))).otherwise(block))
        .when((F.col("line_no") > toc) & (F.col("line_no") < F.coalesce("next", F.lit(1 << 62))), F.slice(F.array(own), 1, 0))
        .when(F.col("entry"), F.array(own, at(toc, F.col("nth") + 1, bullet))).otherwise(F.array(own))
    )
    return df.select("doc_id", F.inline(rows))


def promote_outline(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, promoted): the numbered list that a word processor's outline was flattened to becomes two levels of headings and a list below them.

    Only documents with marks of such a list (stacked bullets, or numbered lines of depth one all above any heading)
    with at least three lines of depth one and some deeper are rewritten. A line's depth is its place
    among the open indents of its block; blocks end at blanks and headings. The open
    indents are those of the block's lines up to it, folded once per line.
    """
    line = F.col("line")
    item = line.rlike(OUTLINE_LINE)
    edge = line.rlike(ATX) | (strip(line) == "")
    df = lines.select("doc_id", "line_no", "line", item.alias("item"), edge.alias("edge"))
    df = df.withColumn("item", F.col("item") & ~F.col("edge")).withColumn("block", F.sum(F.col("edge").cast("int")).over(upto()))
    df = df.withColumn("h", F.coalesce(F.last(F.when(line.rlike(ATX), F.length(F.regexp_extract("line", ATX, 1))), ignorenulls=True).over(upto()), F.lit(0)))
    marks = F.regexp_extract("line", OUTLINE_LINE, 1)
    df = df.withColumn("marked", F.col("item") & (marks != "")).withColumn("col", F.when(F.col("item"), F.length(marks) + F.length(F.regexp_extract("line", OUTLINE_LINE, 2))))
    # Depth: the strictly rising chain of earlier indents of the block that no smaller one has closed since.
    cols = F.transform(F.array_sort(F.collect_list(F.when(F.col("item"), F.struct("line_no", "col"))).over(Window.partitionBy("doc_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))), lambda x: x["col"])
    stack = F.aggregate(cols, F.array().cast("array<int>"), lambda s, c: F.concat(F.filter(s, lambda x: x < c), F.array(c)))
    df = df.withColumn("depth", F.when(F.col("item"), F.size(stack)))
    one = F.col("item") & (F.col("depth") == 1)
    total = lambda c: F.sum(c.cast("int")).over(whole())
    df = df.withColumn("ok", ((total(F.col("marked")) > 0) | ((total(one & (F.col("h") == 0)) > 0) & (total(one & (F.col("h") > 0)) == 0))) & (total(one) >= 3) & (total(F.coalesce(F.col("depth") >= 2, F.lit(False))) > 0))
    text = F.concat(F.regexp_extract("line", OUTLINE_LINE, 3), F.lit(". "), F.regexp_extract("line", OUTLINE_LINE, 4))
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.col("h") + F.col("depth"), F.lit(6))), F.lit(" "), text)
    nested = F.concat(F.repeat(F.lit("  "), F.col("depth") - OUTLINE_HEADINGS - 1), F.lit("- "), text)
    change = F.col("ok") & F.col("item")
    return df.select("doc_id", "line_no", F.when(change & (F.col("depth") <= OUTLINE_HEADINGS), heading).when(change, nested).otherwise(F.col("line")).alias("line"), (change & (F.col("depth") <= OUTLINE_HEADINGS)).cast("int").alias("promoted"))


def cleanup(docs: DataFrame, level: str = "basic", cross_refs: str = "keep") -> DataFrame:
    """(doc_id, md): embedded HTML, entities, emphasis, outlines, the rules of a line, tables, blank runs and the passes over headings, in this order; ``off`` changes nothing. The lines are written to the checkpoint folder twice on the way."""
    if level == "off":
        return docs.select("doc_id", "md")
    hard = level == "aggressive"
    lines = explode_lines(docs.select("doc_id", fragments.clean_text(F.col("md")).alias("md")))
    lines = lines.select("doc_id", "line_no", collapse_emphasis(F.col("line")).alias("line"))
    lines = promote_outline(lines).select("doc_id", "line_no", "line", "promoted")
    lines = checkpointed(lines.withColumn("outline", F.max("promoted").over(whole())).drop("promoted"))
    outlined = lines.where("outline = 1").select("doc_id").distinct()
    lines = lines.drop("outline")
    if cross_refs == "remap":
        lines = links.remap_page_refs(lines)
    if hard:
        toc = F.contains("line", F.lit("Table of Contents"))
        lines = lines.where(toc | ~is_image_only(F.col("line"))).withColumn("line", F.when(toc, F.lit("## Table of Contents")).otherwise(F.col("line")))
    anchors = F.when((F.regexp_replace("line", r"^\s+", "").startswith("#")) & F.lit(not hard and cross_refs == "keep"), refs.matches(F.col("line"), links.ANCHOR_SPAN.replace("(", "").replace(")", ""))).otherwise(F.array().cast("array<string>"))
    parts = lines.select("doc_id", "line_no", F.posexplode(F.concat(F.array(clean_line(F.col("line"), hard, cross_refs)), anchors)).alias("part", "line"))
    lines = _renumbered(parts)
    is_table = strip(F.col("line")).startswith("|") & strip(F.col("line")).endswith("|")
    rest = lines.where(~is_table).select("doc_id", "line_no", F.lit(0).alias("part"), "line")
    lines = squeeze_blanks(_renumbered(rest.unionByName(tables.normalize_tables(lines))))
    lines = checkpointed(headings.dedupe_consecutive(lines).join(outlined.withColumn("outline", F.lit(1)), "doc_id", "left"))
    done = headings.heading_passes(lines.where("outline is null").drop("outline")).unionByName(headings.outline_passes(lines.where("outline = 1").drop("outline")))
    return collect_lines(done).select("doc_id", F.concat(strip(F.col("md")), F.lit("\n")).alias("md"))


def _renumbered(parts: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of lines in parts."""
    return parts.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "part")) - 1).cast("bigint").alias("line_no"), "line")
