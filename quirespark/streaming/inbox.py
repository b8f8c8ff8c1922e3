"""An inbox of documents as a stream: files that arrive become chunks, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.lines import explode_lines
from ..operators.sections import chunks

SCHEMA = "doc_id bigint, md string"


def watch(spark: SparkSession, inbox: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (doc_id, md) records from newline-delimited JSON files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(inbox)


def chunk_stream(stream: DataFrame, out: str, checkpoint: str, min_body: int = 20) -> StreamingQuery:
    """Chunks of every micro-batch, written to a folder of the batch's number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunks(explode_lines(batch), min_body).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
