"""Levels of headings: what the numbering says, which mode a document needs, and what a model would be asked.

Headings are the lines of one to six marks and a space, in fences too. Model answers come in
as a column of text; calling a model is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import heuristic_level, is_structural, marker_pollution, strip
from .lines import upto, whole

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
MIN_HEADINGS, COLLAPSE_MIN, NUMBERED_SHARE = 6, 40, 0.40
ANCHOR_CHARS = 800
MAX_INPUT_TOKENS = 100_000
REPLY = r"^\s*(\d+)\s*:\s*(\d+)\s*$"


def headings(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, h_no, level, text, clean, structural): headings in their order; h_no counts them all."""
    df = lines.where(F.col("line").rlike(HEADING)).select("doc_id", "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("text"))
    df = df.withColumn("clean", marker_pollution(F.col("text"))).withColumn("structural", is_structural(F.col("clean")))
    return df.withColumn("h_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))


def targets(heads: DataFrame, structural: bool = True) -> DataFrame:
    """The headings that are looked at, numbered by ``idx``; none of documents with fewer than two headings or two of these."""
    w = Window.partitionBy("doc_id")
    df = heads.withColumn("n", F.count("*").over(w)).where("n >= 2")
    if structural:
        df = df.where("structural").withColumn("n", F.count("*").over(w)).where("n >= 2")
    return df.drop("n").withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))


def heuristic_levels(heads: DataFrame, structural: bool = True) -> DataFrame:
    """(doc_id, idx, text, new_level) of headings whose numbering says another level than they have."""
    df = targets(heads, structural).withColumn("new_level", heuristic_level(F.col("text")))
    return df.where("new_level <> level").select("doc_id", "idx", "text", "new_level")


def apply_levels(lines: DataFrame, plan: DataFrame, structural: bool = True) -> DataFrame:
    """(doc_id, line_no, line) with the levels of (doc_id, idx, text, new_level); level 0 leaves a plain line. A document of which a planned heading has another text by now stays as it is."""
    now = targets(headings(lines), structural).select("doc_id", "line_no", "idx", "text", "level")
    p = plan.select("doc_id", "idx", F.col("text").alias("was"), "new_level")
    df = now.join(p, ["doc_id", "idx"], "right").withColumn("drift", F.max((~F.col("text").eqNullSafe(F.col("was"))).cast("int")).over(whole()))
    new = F.when(F.col("new_level") == 0, F.col("text")).otherwise(F.concat(F.repeat(F.lit("#"), F.col("new_level")), F.lit(" "), "text"))
    todo = df.where("drift = 0 and new_level <> level").select("doc_id", "line_no", new.alias("new"))
    return lines.join(todo, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce("new", "line").alias("line"))


def normalize(lines: DataFrame, structural: bool = True) -> DataFrame:
    """Levels by the numbering: the heuristic mode, which needs no look-up, so it is one pass."""
    heading = F.col("line").rlike(HEADING)
    text, level = F.regexp_extract("line", HEADING, 2), F.length(F.regexp_extract("line", HEADING, 1))
    looked = heading & (is_structural(marker_pollution(text)) if structural else F.lit(True))
    df = lines.select("doc_id", "line_no", "line", heading.alias("h"), looked.alias("t"), level.alias("level"), text.alias("text"))
    df = df.withColumn("n", F.sum(F.col("h").cast("int")).over(whole())).withColumn("m", F.sum(F.col("t").cast("int")).over(whole()))
    new = heuristic_level(F.col("text"))
    change = F.col("t") & (F.col("n") >= 2) & (F.col("m") >= 2) & F.coalesce(new != F.col("level"), F.lit(False))
    return df.select("doc_id", "line_no", F.when(change, F.concat(F.repeat(F.lit("#"), new), F.lit(" "), "text")).otherwise(F.col("line")).alias("line"))


def body_anchors(lines: DataFrame) -> DataFrame:
    """(doc_id, h_no, level, clean, anchor): the first 800 characters of text below each heading."""
    heading = F.col("line").rlike(HEADING)
    df = lines.select("doc_id", "line_no", "line", heading.alias("h")).withColumn("h_no", F.sum(F.col("h").cast("int")).over(upto())).where("h_no > 0")
    got = df.groupBy("doc_id", "h_no").agg(
        F.max(F.when(F.col("h"), F.length(F.regexp_extract("line", HEADING, 1)))).alias("level"), F.max(F.when(F.col("h"), marker_pollution(F.regexp_extract("line", HEADING, 2)))).alias("clean"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    body = strip(F.col("body"))
    cut = F.regexp_replace(F.substring(body, 1, ANCHOR_CHARS), r"\s+$", "")
    return got.select("doc_id", F.col("h_no").cast("int").alias("h_no"), "level", "clean", F.when(F.length(body) > ANCHOR_CHARS, cut).otherwise(body).alias("anchor"))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def prompts(lines: DataFrame, intro: str = "", max_input_tokens: int = MAX_INPUT_TOKENS) -> DataFrame:
    """(doc_id, prompt, with_anchors): a line ``n: level text`` per heading, with the text below it, indented, where that keeps within the budget."""
    a = body_anchors(lines)
    line = F.concat(F.col("h_no").cast("string"), F.lit(": "), F.col("level").cast("string"), F.lit(" "), "clean")
    full = F.when(F.col("anchor") == "", line).otherwise(F.concat(line, F.lit("\n"), F.array_join(F.transform(F.split("anchor", "\n"), lambda x: F.concat(F.lit("    "), x)), "\n")))
    joined = lambda c: F.concat(F.lit(intro), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h_no", c.alias("t")))), lambda x: x["t"]), "\n"))
    df = a.groupBy("doc_id").agg(joined(line).alias("plain"), joined(full).alias("full"))
    fits = estimate_tokens(F.col("full")) <= max_input_tokens
    return df.select("doc_id", F.when(fits, F.col("full")).otherwise(F.col("plain")).alias("prompt"), fits.alias("with_anchors"))


def parse_reply(reply: Column) -> Column:
    """Map of heading number to level (0 to 6) from lines ``n: level``; the last of a number counts."""
    found = F.filter(F.split(reply, "\n"), lambda x: x.rlike(REPLY))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, REPLY, 1).cast("int").alias("n"), F.regexp_extract(x, REPLY, 2).cast("int").alias("level")))
    pairs = F.filter(pairs, lambda p: p["level"] <= 6)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["n"] == p["n"]))
    return F.map_from_entries(last)


def cache_key(heads: DataFrame, model: str = "", mode: str = "llm", version: str = "1") -> DataFrame:
    """(doc_id, key): sixteen hex digits that change with the headings, the model, the mode or the prompt."""
    line = F.concat(F.col("level").cast("string"), F.lit("|"), "clean")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("t")))), lambda x: x["t"]), "\n")
    return heads.groupBy("doc_id").agg(F.substring(F.sha2(F.concat(text, F.lit(f"|{model}|{mode}|{version}")), 256), 1, 16).alias("key"))


def decide(lines: DataFrame, max_input_tokens: int = MAX_INPUT_TOKENS) -> DataFrame:
    """(doc_id, mode, reason, n_headings, dominant, numbered, tokens): which mode a document needs; only a document whose headings are mostly of one level and not numbered needs a model."""
    h = headings(lines)
    df = lines.select("doc_id").distinct().join(
        h.groupBy("doc_id").agg(F.count("*").alias("n"), F.greatest(*[F.count(F.when(F.col("level") == k, 1)) for k in range(1, 7)]).alias("dominant"), F.sum(F.col("structural").cast("int")).alias("numbered")), "doc_id", "left",
    ).na.fill(0, ["n", "dominant", "numbered"])
    size = prompts(lines, max_input_tokens=1 << 30).select("doc_id", estimate_tokens(F.col("prompt")).alias("tokens"))
    df = df.join(size, "doc_id", "left")
    reason = (
        F.when(F.col("n") < MIN_HEADINGS, "too_few_headings").when(F.col("numbered") >= NUMBERED_SHARE * F.col("n"), "numbered").when(F.col("dominant") < COLLAPSE_MIN, "shape_ok")
        .when(F.col("tokens") <= max_input_tokens, "collapsed_non_numbered").otherwise("needs_full_but_oversized")
    )
    df = df.withColumn("reason", reason)
    return df.select("doc_id", F.when(F.col("reason") == "collapsed_non_numbered", "llm_full").otherwise("heuristic").alias("mode"), "reason", F.col("n").alias("n_headings"), "dominant", "numbered")
