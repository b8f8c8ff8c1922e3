"""Page-range chunks of long documents, resumption, usage and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_PAGES = 50


def plan_chunks(docs: DataFrame, pages: int = CHUNK_PAGES) -> DataFrame:
    """(doc_id, chunk_no, page_range) of doc_id and n_pages; documents without pages have none."""
    n = F.col("n_pages").cast("long")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(pages).cast("long")))
    df = docs.select("doc_id", n.alias("n"), F.posexplode(starts).alias("chunk_no", "a"))
    return df.select("doc_id", "chunk_no", F.concat(F.col("a").cast("string"), F.lit("-"), (F.least(F.col("a") + pages, F.col("n")) - 1).cast("string")).alias("page_range"))


def to_do(plans: DataFrame, state: DataFrame) -> DataFrame:
    """Planned chunks that no run completed."""
    return plans.join(state.where("status = 'completed'").select("doc_id", "page_range"), ["doc_id", "page_range"], "left_anti")


def concat_chunks(done: DataFrame) -> DataFrame:
    """(doc_id, md): chunks of a document in order of their first page."""
    first = F.split_part("page_range", F.lit("-"), F.lit(1)).cast("int")
    rows = F.array_sort(F.collect_list(F.struct(first.alias("a"), "raw_md")))
    return done.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["raw_md"]), "\n\n").alias("md"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and models per task, and over all (task null)."""
    return calls.rollup("task").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum((~F.col("success")).cast("int")).alias("failed"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))


def baseline_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, delta): files of two runs by path with their lines: added, removed, changed; equal ones are left out."""
    o, n = old.select("path", F.col("n_lines").alias("o"), F.col("sha256").alias("os")), new.select("path", F.col("n_lines").alias("n"), F.col("sha256").alias("ns"))
    change = F.when(F.col("os").isNull(), "added").when(F.col("ns").isNull(), "removed").when(F.col("os") != F.col("ns"), "changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"), (F.coalesce("n", F.lit(0)) - F.coalesce("o", F.lit(0))).alias("delta")).where("change is not null")


def task_summary(calls: DataFrame) -> DataFrame:
    """Per task, and over all (task null): calls, those that succeeded, tokens, cost, time, models and backends. Calls without a task count as unknown."""
    known = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",").alias(f"{c}s")
    df = calls.withColumn("task", F.when(F.coalesce("task", F.lit("")) == "", "unknown").otherwise(F.col("task")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return df.rollup("task").agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.col("success").cast("int")), F.lit(0)).alias("successful"), total("prompt_tokens"), total("completion_tokens"), total("cost_usd"), total("duration_ms"), known("model"), known("backend"))


#: Stages in their order, with what each leaves behind: files that go stale with any earlier stage, and caches whose keys say what they hold.
STAGE_FILES = (
    ("ingest", ("{stem}.raw.md", "images", "chunks", "manifest.json"), ()), ("cleanup", ("{stem}.cleaned.md",), ()), ("decorations", (), (".decoration-cache",)),
    ("normalize", ("{stem}.normalized.md",), (".heading-normalize-cache",)), ("repair", ("{stem}.repaired.md",), ()), ("structure", ("{stem}.structured.md",), ()),
    ("vision", ("{stem}.visioned.md",), (".vision-cache",)), ("split", ("sections", "INDEX.md"), ()),
)
STAGE_NAMES = tuple(n for n, _, _ in STAGE_FILES)
CHECKPOINTS = tuple(f.removeprefix("{stem}") for _, files, _ in STAGE_FILES for f in files if f.startswith("{stem}."))


def invalidated(runs: DataFrame) -> DataFrame:
    """(doc_id, path): what a run again from a stage (doc_id, stem, stage) makes stale: the files of that stage and all later ones, and that stage's own cache. Later caches stay, since their keys tell."""
    rows = [F.struct(F.lit(i).alias("i"), F.lit(name).alias("stage"), F.array(*[F.lit(f) for f in files]).cast("array<string>").alias("files"), F.array(*[F.lit(c) for c in caches]).cast("array<string>").alias("caches")) for i, (name, files, caches) in enumerate(STAGE_FILES)]
    stages = F.array(*rows)
    own = F.element_at(F.filter(stages, lambda s: s["stage"] == F.col("stage")), 1)
    files = F.flatten(F.transform(F.filter(stages, lambda s: s["i"] >= own["i"]), lambda s: s["files"]))
    return runs.where(F.col("stage").isin(*STAGE_NAMES)).select("doc_id", F.explode(F.concat(own["caches"], files)).alias("f"), "stem").select("doc_id", F.replace("f", F.lit("{stem}"), F.col("stem")).alias("path"))


CLEANUP_FLAGS = ("cleanup", "cross_refs", "strip_frontmatter", "decoration_threshold", "decoration_hamming_distance")


def resume_points(snapshots: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(doc_id, resume): where each document may go on: ``cleaned`` if its clean snapshot is as new as its raw one and was made under the same flags, else ``raw`` if that is as new as its source, else ``source``.

    ``snapshots`` has doc_id, source_time, raw_time and cleaned_time (null where there is none) and flags, a map of the recorded run's.
    """
    same = F.lit(True)
    for k in CLEANUP_FLAGS:
        same = same & F.try_element_at("flags", F.lit(k)).eqNullSafe(F.lit(flags.get(k)))
    raw = F.coalesce(F.col("raw_time") >= F.col("source_time"), F.lit(False))
    clean = F.coalesce(F.col("cleaned_time") >= F.col("raw_time"), F.lit(False)) & F.col("flags").isNotNull() & same
    return snapshots.select("doc_id", F.when(raw & clean, "cleaned").when(raw, "raw").otherwise("source").alias("resume"))


def deliverables(files: DataFrame) -> DataFrame:
    """Files (doc_id, path) that are delivered: masters in markdown, and all below folders of sections or images; checkpoints, caches and hidden files stay."""
    parts = F.split("path", "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    checkpoint = F.lit(False)
    for c in CHECKPOINTS:
        checkpoint = checkpoint | F.endswith(name, F.lit(c))
    inside = F.exists(folders, lambda d: d.isin("sections", "images"))
    hidden = F.exists(folders, lambda d: d.startswith(".") | (d == "chunks"))
    return files.where(~hidden & (inside | (F.endswith(name, F.lit(".md")) & ~checkpoint & ~name.startswith("."))))


def latest_baselines(snapshots: DataFrame) -> DataFrame:
    """(doc_id, label, taken_at, place) of the snapshots of a document, newest first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("taken_at"), F.desc("label"))
    return snapshots.select("doc_id", "label", "taken_at", F.row_number().over(w).alias("place"))


def to_snapshot(runs: DataFrame, version: str) -> DataFrame:
    """Runs (doc_id, version) by another version than this one, whose results are worth keeping before they are replaced."""
    return runs.where(F.col("version").isNotNull() & (F.col("version") != version)).select("doc_id", F.concat(F.lit("v"), "version").alias("label"))


PHASES = ("ingest", "cleanup", "normalize", "repair", "structure", "vision", "split")
PAID = ("anthropic", "openrouter")


def vision_runs(start: Column, stop: Column, diagrams: Column, cache_only: Column) -> Column:
    """Whether a slice of the phases makes calls of a vision model."""
    place = lambda c, default: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PHASES)), c) - 1, F.lit(-1)), F.lit(default))
    at = PHASES.index("vision")
    return diagrams & ~cache_only & (place(start, 0) <= at) & (place(stop, len(PHASES) - 1) >= at)


def gate(jobs: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, images, cached, misses, decision): whether a job (doc_id, runs, backend, confirmed) goes ahead, must be confirmed, or is blocked for a paid backend whose cost nobody knows; ``images`` has doc_id and hit."""
    n = images.groupBy("doc_id").agg(F.count("*").alias("images"), F.sum(F.col("hit").cast("int")).alias("cached"))
    df = jobs.join(n, "doc_id", "left").withColumn("misses", F.col("images") - F.col("cached"))
    unknown = F.col("images").isNull()
    decision = F.when(~F.col("runs"), "go").when(unknown & F.col("backend").isin(*PAID), "blocked").when(F.col("confirmed"), "go").otherwise("confirm")
    return df.select("doc_id", "images", "cached", "misses", decision.alias("decision"))


def run_record(runs: DataFrame) -> DataFrame:
    """(doc_id, record): a run as JSON, null fields left out."""
    return runs.select("doc_id", F.to_json(F.struct(*[c for c in runs.columns if c != "doc_id"])).alias("record"))


def read_run_record(records: DataFrame, schema: str) -> DataFrame:
    """Run records read again; what is no JSON object is null and breaks nothing."""
    return records.select("doc_id", F.when(F.trim("record").startswith("{") & F.try_parse_json("record").isNotNull(), F.from_json("record", schema)).alias("run"))


def source_identity(runs: DataFrame, earlier: DataFrame) -> DataFrame:
    """(doc_id, source_id, sha256): of files (doc_id, name, content) their own; of runs without a file (content null) what an earlier record (doc_id, source_id, sha256) knows."""
    from ..functions.text import source_id

    e = earlier.select("doc_id", F.col("source_id").alias("s0"), F.col("sha256").alias("h0"))
    own = F.col("content").isNotNull()
    df = runs.join(e, "doc_id", "left")
    return df.select("doc_id", F.when(own, F.nullif(source_id(F.col("name")), F.lit(""))).otherwise(F.col("s0")).alias("source_id"), F.when(own, F.sha2("content", 256)).otherwise(F.col("h0")).alias("sha256"))
