"""Defects of extracted markdown as a findings table.

The checks of single lines are one array of findings per line, so all of them are one pass;
those of tables, headings and whole files are a pass each over lines that share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .lines import upto

BR_MIN = 30
DUPLICATES = 4
LABELS = 3
ENTITY = r"&(?:amp|lt|gt|quot|apos|nbsp|ndash|mdash|lsquo|rsquo|ldquo|rdquo|hellip|copy|reg|trade|deg|times|plusmn|middot|bull|sect|para|#\d+|#x[0-9a-fA-F]+);"
TABLE_TAG = r"(?i)</?(?:td|tr|table|tbody|thead|th)\b"
EMPTY_ATTRIBUTE = r'<[^>\n]*=""\s*>'


def prose(lines: DataFrame) -> DataFrame:
    """Lines outside code fences, inline code blanked to a space."""
    mark = F.regexp_replace("line", r"^\s+", "").startswith("```").cast("int")
    df = lines.select("doc_id", "line_no", "line").withColumn("m", mark).withColumn("open", F.sum("m").over(upto()) % 2)
    return df.where("m = 0 and open = 0").select("doc_id", "line_no", F.regexp_replace("line", r"`[^`\n]+`", " ").alias("line"))


def _finding(df: DataFrame, check: str, severity: str, message: Column) -> DataFrame:
    return df.select("doc_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), (F.col("line_no") + 1).alias("line"), message.alias("message"))


def _line_checks(line: Column) -> dict[str, tuple[str, Column, Column]]:
    """Check -> (severity, whether a line outside fences has the defect, message)."""
    cells = F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|")
    worst = F.array_max(F.transform(cells, lambda c: F.regexp_count(c, F.lit(r"(?i)<br\s*/?>"))))
    clean = F.regexp_replace(line, r"\]\(<[^>\n]*>\)", "]()")
    tag = F.regexp_extract(clean, TABLE_TAG, 0)
    hit = F.when(tag != "", tag).otherwise(F.regexp_extract(clean, EMPTY_ATTRIBUTE, 0))
    n = F.regexp_count(line, F.lit(ENTITY))
    return {
        "collapsed_table": ("error", strip(line).startswith("|") & (worst >= BR_MIN), F.concat(F.lit("table cell of "), worst.cast("string"), F.lit(" joined lines"))),
        "html_fragment": ("error", hit != "", F.concat(F.lit("left-over HTML of a table: "), hit)),
        "html_entity": ("error", n > 0, F.concat(n.cast("string"), F.lit(" entities left"))),
        "shattered_emphasis": ("error", line.rlike(r"\*{4,}") & ~line.rlike(r"^\s*\*+\s*$"), F.lit("four or more emphasis marks in a row")),
    }


def line_findings(lines: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all checks of single lines, in one pass."""
    found = [F.when(when, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), message.alias("message"))) for name, (severity, when, message) in _line_checks(F.col("line")).items() if not only or name in only]
    df = prose(lines).select("doc_id", "line_no", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return df.select("doc_id", "x.check", "x.severity", (F.col("line_no") + 1).alias("line"), "x.message")


def collapsed_table(lines: DataFrame) -> DataFrame:
    return line_findings(lines, ("collapsed_table",))


def html_fragment(lines: DataFrame) -> DataFrame:
    return line_findings(lines, ("html_fragment",))


def replacement_char(lines: DataFrame) -> DataFrame:
    df = lines.where(F.contains("line", F.lit("\ufffd"))).groupBy("doc_id").agg(F.min("line_no").alias("line_no"), F.sum(F.length("line") - F.length(F.replace("line", F.lit("\ufffd")))).alias("n"))
    return _finding(df, "replacement_char", "error", F.concat(F.col("n").cast("string"), F.lit(" replacement characters")))


def html_entity(lines: DataFrame) -> DataFrame:
    return line_findings(lines, ("html_entity",))


def shattered_emphasis(lines: DataFrame) -> DataFrame:
    return line_findings(lines, ("shattered_emphasis",))


def misaligned_table(lines: DataFrame) -> DataFrame:
    """Two labels in one cell of a column of labels."""
    table = strip(F.col("line")).startswith("|")
    df = prose(lines).withColumn("table", table).withColumn("run", F.sum((~table).cast("int")).over(upto())).where("table")
    cells = F.transform(F.split(F.regexp_replace(strip(F.col("line")), r"^\|+|\|+$", ""), r"\|", -1), lambda c: strip(c))
    df = df.select("doc_id", "run", "line_no", cells.alias("cells")).where(~F.forall("cells", lambda c: c.rlike(r"^:?-{3,}:?$|^$")))
    df = df.withColumn("rows", F.count("*").over(Window.partitionBy("doc_id", "run"))).where(F.col("rows") >= LABELS)
    filled = F.size(F.filter("cells", lambda c: c != ""))
    one = df.select("doc_id", "run", "line_no", filled.alias("filled"), F.posexplode("cells").alias("col", "cell")).where("cell <> ''")
    w = Window.partitionBy("doc_id", "run", "col")
    one = one.withColumn("labels", F.sum(F.endswith("cell", F.lit(":")).cast("int")).over(w)).withColumn("all", F.count("*").over(w))
    hit = (F.col("labels") >= LABELS) & (F.col("labels") * 2 >= F.col("all")) & F.col("cell").rlike(r"\S:\s+\S") & (F.col("filled") > 1)
    return _finding(one.where(hit), "misaligned_table", "warning", F.concat(F.lit("two labels in a cell: "), F.substring("cell", 1, 60)))


def duplicate_heading(lines: DataFrame) -> DataFrame:
    p = r"^(#{1,6})\s+(.+?)\s*$"
    df = prose(lines).where(F.col("line").rlike(p)).withColumn("title", F.regexp_extract("line", p, 2)).withColumn("key", F.lower("title")).where("key <> 'subsections'")
    df = df.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "title")).alias("f")).where(F.col("n") >= DUPLICATES)
    return _finding(df.select("doc_id", "n", F.col("f.line_no").alias("line_no"), F.col("f.title").alias("title")), "duplicate_heading", "warning", F.concat(F.lit("heading '"), F.col("title"), F.lit("' "), F.col("n").cast("string"), F.lit(" times")))


def empty_section(lines: DataFrame) -> DataFrame:
    """Files of headings, crumbs and page anchors only, without a list of subsections; front matter doesn't count."""
    s = strip(F.col("line"))
    nth = F.sum((s == "---").cast("int")).over(upto())
    fronted = F.max(((F.col("line_no") == 0) & (s == "---")).cast("int")).over(Window.partitionBy("doc_id"))
    ends = F.sum((s == "---").cast("int")).over(Window.partitionBy("doc_id"))
    df = lines.select("doc_id", "line_no", "line", s.alias("s"), nth.alias("nth"), fronted.alias("fronted"), ends.alias("ends"))
    head = (F.col("fronted") == 1) & (F.col("ends") > 1) & ((F.col("nth") < 2) | ((F.col("nth") == 2) & (F.col("s") == "---")))
    plain = ~head & (F.col("s") != "") & ~F.col("s").startswith("#") & ~F.col("s").startswith("> ↑") & ~F.col("s").rlike(r'^<span id="page-\d+-\d+"></span>$')
    df = df.groupBy("doc_id").agg(F.lit(0).cast("bigint").alias("line_no"), F.max(plain.cast("int")).alias("body"), F.max((~head & (F.col("s") == "## Subsections")).cast("int")).alias("sub"))
    return _finding(df.where("body = 0 and sub = 0"), "empty_section", "warning", F.lit("no body"))


CHECKS = {f.__name__: f for f in (collapsed_table, misaligned_table, html_fragment, replacement_char, html_entity, shattered_emphasis, duplicate_heading, empty_section)}


def dangling_images(lines: DataFrame, files: DataFrame) -> DataFrame:
    """References to images that ``files`` (doc_id, path) doesn't have, as they are or percent-decoded."""
    refs = lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"!\[[^\]]*\]\(([^)\n]+)\)"), 1)).alias("target")).withColumn("target", strip(F.col("target")))
    refs = refs.withColumn("target", F.when(F.col("target").rlike("^<.*>$"), strip(F.regexp_extract("target", "^<(.*)>$", 1))).otherwise(F.col("target"))).where(~F.col("target").rlike(r"^(?:https?://|data:)") & (F.col("target") != ""))
    have = files.select(F.col("doc_id").alias("d"), "path")
    gone = refs.join(have, (refs.doc_id == have.d) & (refs.target == have.path), "left_anti")
    gone = gone.join(have, (gone.doc_id == have.d) & (F.try_url_decode(gone.target) == have.path), "left_anti")
    return _finding(gone, "dangling_image", "error", F.concat(F.lit("no file "), F.col("target")))


def audit(lines: DataFrame) -> DataFrame:
    """Findings of all text checks."""
    out = line_findings(lines)
    for f in (misaligned_table, replacement_char, duplicate_heading, empty_section):
        out = out.unionByName(f(lines))
    return out


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def report(findings: DataFrame, most: int = 3) -> DataFrame:
    """The first findings of a check and document, and how many more there are."""
    w = Window.partitionBy("doc_id", "check")
    df = findings.withColumn("rn", F.row_number().over(w.orderBy("line", "message"))).withColumn("n", F.count("*").over(w))
    return df.where(F.col("rn") <= most).select("doc_id", "check", "severity", "line", "message", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))
