"""References joined with what they point to: captions, files, headings, pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import refs as R
from ..functions.text import slug, strip, strip_page_spans
from .lines import upto

ANCHOR_SPAN = r'<span id="(page-\d+-\d+)"></span>'
HAMMING, THRESHOLD = 12, 5
#: Pairs of hashes compared at once, and images of a document up to which it is handled together with others of its size.
BLOCK, SMALL = 1 << 22, 32


def image_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, alt, target, basename) of every image reference of (doc_id, md)."""
    r = docs.select("doc_id", F.posexplode(R.matches(F.col("md"), R.IMAGE)).alias("pos", "ref"))
    return r.select("doc_id", "pos", R.alt_of(F.col("ref")).alias("alt"), R.target_of(F.col("ref")).alias("target"), R.basename(R.target_of(F.col("ref"))).alias("basename"))


def alt_by_basename(docs: DataFrame) -> DataFrame:
    """(doc_id, basename, alt): the alternative text of an image's first reference."""
    return image_refs(docs).groupBy("doc_id", "basename").agg(F.min_by("alt", "pos").alias("alt"))


def _lookup(docs: DataFrame, rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Adds ``known``, a document's rows as a map; only what its references name is brought to it."""
    per = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))).alias("known"))
    return docs.join(per, "doc_id", "left")


def inject_captions(docs: DataFrame, diagrams: DataFrame, keep_alt: bool = False) -> DataFrame:
    """(doc_id, md) with the captions of (doc_id, basename, caption, mermaid) as alternative texts and the diagrams behind their images; other images stay."""
    named = image_refs(docs).select("doc_id", "basename").distinct()
    df = _lookup(docs, diagrams.join(named, ["doc_id", "basename"], "left_semi"), "basename", F.struct("caption", "mermaid"))

    def rule(ref: Column) -> Column:
        path = R.target_of(ref)
        d = F.try_element_at("known", R.basename(path))
        safe = strip(F.replace(F.translate(d["caption"], "[]", "()"), F.lit("\n"), F.lit(" ")))
        own = ref if keep_alt else F.concat(F.lit("!["), safe, F.lit("]("), path, F.lit(")"))
        with_chart = F.concat(own, F.lit('\n\n```mermaid image="'), path, F.lit('"\n'), d["mermaid"], F.lit("\n```"))
        return F.when(d.isNull(), ref).when(F.coalesce(d["mermaid"], F.lit("")) != "", with_chart).otherwise(own)

    return df.select("doc_id", R.rewrite(F.col("md"), R.IMAGE, rule).alias("md"))


def degrade_missing_images(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, md, degraded): references to files that (doc_id, path) lacks, as they are or percent-decoded, become their alternative text in italics."""
    df = _lookup(docs, files.select("doc_id", "path").distinct(), "path", F.lit(True))

    def target(ref: Column) -> Column:
        t = strip(R.target_of(ref))
        return F.when(t.rlike("^<.*>$"), strip(F.regexp_extract(t, "^<(.*)>$", 1))).otherwise(t)

    def gone(ref: Column) -> Column:
        t = target(ref)
        have = F.coalesce(F.map_contains_key("known", t), F.lit(False)) | F.coalesce(F.map_contains_key("known", F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)), F.lit(False))
        return ~(t.rlike(r"^(https?://|data:)") | (t == "") | have)

    alt = lambda ref: strip(R.alt_of(ref))
    rule = lambda ref: F.when(~gone(ref), ref).when(alt(ref) == "", "").otherwise(F.concat(F.lit("_"), alt(ref), F.lit("_")))
    count = F.size(F.filter(R.matches(F.col("md"), R.IMAGE), gone))
    return df.select("doc_id", R.rewrite(F.col("md"), R.IMAGE, rule).alias("md"), count.alias("degraded"))


def retarget_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, md): references whose base name is an extracted image of (doc_id, name) point to ``images/``; a text without any reference gets them all at its end."""
    per = images.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))

    def rule(ref: Column) -> Column:
        name = R.basename(R.target_of(ref))
        return F.when(F.coalesce(F.array_contains("names", name), F.lit(False)), F.concat(F.lit("!["), R.alt_of(ref), F.lit("](images/"), name, F.lit(")"))).otherwise(ref)

    added = F.concat(F.lit("\n\n## Extracted Images\n"), F.array_join(F.transform("names", lambda n: F.concat(F.lit("\n!["), n, F.lit("](images/"), n, F.lit(")\n"))), ""))
    has = F.contains("md", F.lit("![")) & F.contains("md", F.lit("]("))
    return docs.join(per, "doc_id", "left").select("doc_id", F.when(has | F.col("names").isNull(), R.rewrite(F.col("md"), R.IMAGE, rule)).otherwise(F.concat("md", added)).alias("md"))


def anchor_map(lines: DataFrame) -> DataFrame:
    """(doc_id, anchor, slug): each page anchor with the slug of the heading on its line or the next one below; the last of an anchor counts."""
    line = F.col("line")
    bare = strip(strip_page_spans(strip(line)))
    heading = bare.startswith("#") | bare.rlike(r"^\s*(\d+(?:\.\d+)*\.)\s+(.+?)\s*$")
    below = Window.partitionBy("doc_id").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = lines.select("doc_id", "line_no", F.regexp_extract_all("line", F.lit(ANCHOR_SPAN), 1).alias("anchors"), F.when(heading & (slug(line) != ""), slug(line)).alias("s"))
    df = df.withColumn("slug", F.last("s", ignorenulls=True).over(below)).where("slug is not null and size(anchors) > 0")
    return df.select("doc_id", "line_no", "slug", F.posexplode("anchors").alias("p", "anchor")).groupBy("doc_id", "anchor").agg(F.max_by("slug", F.struct("line_no", "p")).alias("slug"))


def remap_page_refs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): references to pages point to the heading that follows the page's anchor; without one the label stays."""
    known = anchor_map(lines)
    wanted = lines.where(line_has := F.col("line").rlike(R.PAGE_LINK))
    refs = wanted.select("doc_id", "line_no", F.explode(F.array_distinct(F.transform(R.matches(F.col("line"), R.PAGE_LINK), R.anchor_of))).alias("anchor"))
    found = refs.join(known, ["doc_id", "anchor"]).groupBy("doc_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("anchor", "slug"))).alias("known"))

    def rule(ref: Column) -> Column:
        s = F.try_element_at("known", R.anchor_of(ref))
        return F.when(s.isNull(), R.label_of(ref)).otherwise(F.concat(F.lit("["), R.label_of(ref), F.lit("](#"), s, F.lit(")")))

    return lines.join(found, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.when(line_has, R.rewrite(F.col("line"), R.PAGE_LINK, rule)).otherwise(F.col("line")).alias("line"))


def figures_by_page(figures: DataFrame, markers: DataFrame) -> DataFrame:
    """(doc_id, figure, question): the last question marker (doc_id, page, top, question) at or before a figure's page (doc_id, page, figure), pages read from the top."""
    f = figures.select("doc_id", "page", F.lit(1).alias("kind"), F.lit(0.0).alias("at"), "figure", F.lit(None).cast("int").alias("question"))
    m = markers.select("doc_id", "page", F.lit(0).alias("kind"), (-F.col("top")).cast("double").alias("at"), F.lit(None).cast("string").alias("figure"), F.col("question").cast("int"))
    w = Window.partitionBy("doc_id").orderBy("page", "kind", "at", "question", "figure").rowsBetween(Window.unboundedPreceding, 0)
    return f.union(m).withColumn("q", F.last("question", ignorenulls=True).over(w)).where("kind = 1").select("doc_id", "figure", F.col("q").alias("question"))


def cache_lookup(images: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc_id, basename, phash, hit, caption): images (doc_id, basename, phash) with what the cache (phash, caption) holds of them; a cached caption counts whatever model made it."""
    return images.join(cache.select("phash", "caption", F.lit(True).alias("h")), "phash", "left").select("doc_id", "basename", "phash", F.coalesce("h", F.lit(False)).alias("hit"), "caption")


def _components(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a document's hashes the least of each one's chain, and the chain's number of images. Each hash is compared once with those not reached yet, some four million pairs at a time."""
    uniq, inv, n = np.unique(values, return_inverse=True, return_counts=True)
    root = np.empty(len(uniq), np.int64)
    left = np.arange(len(uniq))
    while len(left):
        at, left = left[:1], left[1:]
        least = uniq[at[0]]
        while len(at):
            root[at] = least
            todo, found = at, []
            while len(todo) and len(left):
                k = max(1, BLOCK // len(left))
                near = (np.bitwise_count((uniq[todo[:k], None] ^ uniq[None, left]).view(np.uint64)) <= distance).any(axis=0)
                found.append(left[near])
                todo, left = todo[k:], left[~near]
            at = np.concatenate(found) if found else left[:0]
    _, which = np.unique(root, return_inverse=True)
    return root[inv], np.bincount(which, weights=n).astype(np.int64)[which][inv]


def _small_components(m: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of many documents with as many images each, a row per document."""
    near = np.bitwise_count((m[:, :, None] ^ m[:, None, :]).view(np.uint64)) <= distance
    root, top = m, np.iinfo(np.int64).max
    while True:
        now = np.where(near, root[:, None, :], top).min(axis=2)
        if (now == root).all():
            return root, (root[:, :, None] == root[:, None, :]).sum(axis=2)
        root = now


def _clusters(threshold: int, distance: int):
    @F.arrow_udf("array<bigint>")
    def clusters(hashes: pa.Array) -> pa.Array:
        """For each hash of a document the least one of its cluster; null where the cluster is smaller than the threshold."""
        flat, size = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), hashes.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        root, n = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        for k in np.unique(size):
            starts = (ends - size)[size == k]
            if k > SMALL:
                for i in starts:
                    root[i : i + k], n[i : i + k] = _components(flat[i : i + k], distance)
            elif k:
                step = max(1, BLOCK // int(k * k))
                for i in range(0, len(starts), step):
                    at = starts[i : i + step, None] + np.arange(k)
                    root[at], n[at] = _small_components(flat[at], distance)
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(root, pa.int64(), mask=n < threshold))

    return clusters


def decorations(images: DataFrame, threshold: int = THRESHOLD, distance: int = HAMMING) -> DataFrame:
    """(doc_id, basename, cluster): images (doc_id, basename, phash as bigint) of a document that look alike, in clusters of ``threshold`` or more.

    An image joins the clusters of those within ``distance`` bits through chains of any length. A
    document's images are one row, so the only exchange is on doc_id; its hashes are compared all
    with all, in blocks, and no pair is stored.
    """
    rows = images.where("doc_id is not null and phash is not null").groupBy("doc_id").agg(F.collect_list(F.struct("phash", "basename")).alias("rows")).where(F.size("rows") >= threshold)
    rows = rows.withColumn("roots", _clusters(threshold, distance)(F.transform("rows", lambda x: x["phash"])))
    found = F.filter(F.zip_with("rows", "roots", lambda x, r: F.struct(x["basename"].alias("basename"), r.alias("cluster"))), lambda x: x["cluster"].isNotNull())
    return rows.select("doc_id", F.inline(found))


def strip_decorations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, md) without references to decorations; at most one blank line in a row."""
    df = _lookup(docs, found.select("doc_id", "basename").distinct(), "basename", F.lit(True))
    rule = lambda ref: F.when(F.coalesce(F.map_contains_key("known", R.basename(R.target_of(ref))), F.lit(False)), "").otherwise(ref)
    gone = F.regexp_replace(R.rewrite(F.col("md"), R.IMAGE, rule), r"\n{3,}", "\n\n")
    return df.select("doc_id", F.when(F.col("known").isNull(), F.col("md")).otherwise(gone).alias("md"))


def lines_in_tables(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, line_no, first_line): lines with the table (doc_id, first_line, last_line) that covers them.

    Tables of a document don't overlap, so the range join is the latest block that began, checked for its end.
    """
    b = blocks.select("doc_id", F.col("first_line").alias("line_no"), F.col("last_line").alias("to"))
    df = lines.select("doc_id", "line_no").join(b, ["doc_id", "line_no"], "left").withColumn("from", F.when(F.col("to").isNotNull(), F.col("line_no")))
    df = df.withColumn("f", F.last("from", ignorenulls=True).over(upto())).withColumn("t", F.last("to", ignorenulls=True).over(upto()))
    return df.where("line_no <= t").select("doc_id", "line_no", F.col("f").alias("first_line"))
