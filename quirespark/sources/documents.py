"""Readers and writers of documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sections
from ..operators.lines import explode_lines

#: Suffix -> how a file is read.
BACKENDS = {"md": "markdown", "markdown": "markdown", "txt": "markdown", "html": "html", "htm": "html", "xml": "quiz", "zip": "archive", "pdf": "pages", "docx": "office", "pptx": "office", "epub": "office", "png": "image", "jpg": "image", "jpeg": "image"}


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(doc_id, path, suffix, backend, sha256, content) of the files below a folder; a null backend is an unknown suffix."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    backend = F.coalesce(*[F.when(suffix == s, F.lit(b)) for s, b in BACKENDS.items()])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", suffix.alias("suffix"), backend.alias("backend"), F.sha2("content", 256).alias("sha256"), "content")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, md) of the markdown files below a folder."""
    files = read_files(spark, path).where("backend = 'markdown'")
    return files.select("doc_id", "path", F.col("content").cast("string").alias("md"))


def read_records(spark: SparkSession, path: str, schema: str = "doc_id bigint, md string") -> DataFrame:
    """Newline-delimited JSON records under a fixed schema, so no pass over the data infers one."""
    return spark.read.schema(schema).json(path)


def write_chunks(docs: DataFrame, path: str, min_body: int = sections.MIN_BODY, nested: bool = False) -> DataFrame:
    """Writes the section files of (doc_id, md) as Parquet, each with its whole text, its identity in front matter and its list of subsections, and returns what was written.

    Rows are laid out by document hash, so that a reader of one document prunes to one folder. An earlier
    split in the folder is replaced, so no stale file stays.
    """
    lines = explode_lines(docs)
    s = sections.identified(sections.tree(lines), nested, min_body)
    files = sections.section_contents(s)
    files.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(path)
    return docs.sparkSession.read.parquet(path)


def index_entries(files: DataFrame) -> DataFrame:
    """(doc_id, md): a document's index, a link per file, indented by its depth."""
    line = F.concat(F.repeat(F.lit("  "), F.size("section_path")), F.lit("- ["), "shown", F.lit("]("), "section_id", F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("order", line.alias("line"))))
    return files.groupBy("doc_id").agg(F.concat(F.lit("# Index\n\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("md"))
