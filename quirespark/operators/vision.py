"""Captions of images: what a model said, whether it speaks of the same thing as the author, and what to fall back to.

Models are called by the caller; their replies come in as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

MIN_ALT, MIN_ANCHOR, WINDOW, STEM, SHOWN, MIN_FALLBACK = 60, 4, 18, 5, 5, 12
WORD = r"([a-z][a-z\-]{2,})"
#: Words that any caption may have; they name no subject.
GENERIC = tuple(sorted(
    "illustration illustrated photograph photo diagram image images shows showing show shown labeled labelled cross section sectional view views panel panels figure color colored colour close closeup detailed schematic drawing depicts depicting displays displaying display structure structures parts part major human body side left right "
    "this that with and the for from into two three four five their which various different between within containing each where while small large upper lower front back inside outer inner top bottom middle center central frontal lateral horizontal vertical magnified callout inset leader lines arrows labels title titled graph chart table "
    "comparison comparing types type process system systems overview general complete".split()
))


def subject_words(alt: Column) -> Column:
    """Words among the first eighteen that name a subject, in order, repeats kept."""
    first = F.slice(F.regexp_extract_all(F.lower(alt), F.lit(WORD), 1), 1, WINDOW)
    return F.filter(first, lambda w: ~w.isin(*GENERIC) & (F.length(w) >= MIN_ANCHOR))


def is_assessable(alt: Column) -> Column:
    return (F.length(strip(alt)) >= MIN_ALT) & (F.size(subject_words(alt)) > 0)


def divergence(alts: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc_id, basename, alt, caption, dropped): images whose caption has the stem of none of the words that their alternative text (doc_id, basename, alt) begins with; up to six of these are shown."""
    df = captions.join(alts, ["doc_id", "basename"]).withColumn("alt", strip(F.col("alt"))).where(is_assessable(F.col("alt"))).withColumn("w", subject_words(F.col("alt")))
    low = F.lower(F.coalesce("caption", F.lit("")))
    return df.where(~F.exists("w", lambda a: F.contains(low, F.substring(a, 1, STEM)))).select("doc_id", "basename", "alt", "caption", F.array_join(F.slice("w", 1, 6), ", ").alias("dropped"))


def audit(alts: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc_id, assessed, findings) per document with captions."""
    seen = captions.join(alts, ["doc_id", "basename"], "left").groupBy("doc_id").agg(F.sum(F.coalesce(is_assessable(F.col("alt")), F.lit(False)).cast("int")).alias("assessed"))
    n = divergence(alts, captions).groupBy("doc_id").agg(F.count("*").alias("findings"))
    return seen.join(n, "doc_id", "left").na.fill(0, ["findings"])


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n, line): up to five findings of a document as text, and how many more there are."""
    w = Window.partitionBy("doc_id")
    df = found.withColumn("rn", F.row_number().over(w.orderBy("basename"))).withColumn("all", F.count("*").over(w)).where(F.col("rn") <= SHOWN + 1)
    text = F.concat(F.lit("  "), "basename", F.lit("  (source names: "), "dropped", F.lit(")\n    ALT: "), F.substring("alt", 1, 120), F.lit("\n    CAP: "), F.substring("caption", 1, 120))
    more = F.concat(F.lit("  … and "), (F.col("all") - SHOWN).cast("string"), F.lit(" more in this doc"))
    return df.select("doc_id", F.col("rn").alias("n"), F.when(F.col("rn") <= SHOWN, text).otherwise(more).alias("line"))


def parse_reply(reply: Column, name: Column) -> Column:
    """Struct of parsed, is_diagram, diagram_type, caption and mermaid from a reply with a JSON object somewhere in it; unparsed where there is none."""
    raw = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    j = F.from_json(raw, "is_diagram boolean, diagram_type string, caption string, mermaid string")
    ok = (raw != "") & F.try_parse_json(raw).isNotNull()
    diagram = F.coalesce(j["is_diagram"], F.lit(False))
    caption = F.when(F.coalesce(j["caption"], F.lit("")) != "", j["caption"]).otherwise(F.concat(F.lit("Image at "), name, F.lit(".")))
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("parsed"), F.when(ok, diagram).otherwise(False).alias("is_diagram"), F.when(ok, j["diagram_type"]).alias("diagram_type"),
        F.when(ok, caption).otherwise(F.concat(F.lit("Image at "), name, F.lit(" (description unavailable)."))).alias("caption"), F.when(ok & diagram, j["mermaid"]).alias("mermaid"),
    )


def failure_caption(name: Column, alt: Column) -> Column:
    """The author's text if it says anything, else that there is none."""
    a = strip(F.coalesce(alt, F.lit("")))
    return F.when(F.length(a) >= MIN_FALLBACK, a).otherwise(F.concat(F.lit("Image at "), name, F.lit(" (extraction failed).")))


def enrich(images: DataFrame, cache: DataFrame, replies: DataFrame) -> DataFrame:
    """(doc_id, basename, phash, source, caption, mermaid): captions of images (doc_id, basename, phash, alt) from the cache (phash, caption, mermaid), else from replies (phash, reply), else a fallback."""
    r = replies.select("phash", F.col("reply"))
    df = images.join(cache.select("phash", F.col("caption").alias("cc"), F.col("mermaid").alias("cm"), F.lit(True).alias("hit")), "phash", "left").join(r, "phash", "left")
    df = df.withColumn("p", parse_reply(F.col("reply"), F.col("basename")))
    hit, ok = F.coalesce("hit", F.lit(False)), F.coalesce("p.parsed", F.lit(False))
    return df.select(
        "doc_id", "basename", "phash", F.when(hit, "cache").when(ok, "model").otherwise("fallback").alias("source"),
        F.when(hit, F.col("cc")).when(ok, F.col("p.caption")).otherwise(failure_caption(F.col("basename"), F.col("alt"))).alias("caption"), F.when(hit, F.col("cm")).when(ok, F.col("p.mermaid")).alias("mermaid"),
    )


def prompt(alt: Column, template: str = "Describe the image.{alt}") -> Column:
    """What a model is asked about an image, with the author's text where there is one."""
    a = F.when(strip(F.coalesce(alt, F.lit(""))) != "", F.concat(F.lit("\nThe source describes it as: "), strip(alt))).otherwise(F.lit(""))
    before, _, behind = template.partition("{alt}")
    return F.concat(F.lit(before), a, F.lit(behind))


def model_mismatch(cache: DataFrame, model: str) -> DataFrame:
    """(model, n) of cached captions by other models than the one asked for; they count all the same."""
    return cache.where(F.col("model").isNotNull() & (F.col("model") != model)).groupBy("model").agg(F.count("*").alias("n"))
