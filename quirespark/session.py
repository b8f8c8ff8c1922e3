"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}
#: Bytes of an Arrow batch that goes to a Python worker; Spark's own default keeps several of 64 MB per task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder that ``spark.checkpoint.dir`` names and read again, so that what follows neither repeats it nor carries its plan. Without that setting a local session gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The frame in a partition per so many rows, for work that is large beside the bytes it is made from; Spark would put a small table into one task, whatever is done with each row. Counting a file's rows reads its footer only."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor, and bound their batches where the session says nothing else; done once per application."""
    if spark.conf.get(BATCH, "67108864b") == "67108864b":
        spark.conf.set(BATCH, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="quirespark-"), "quirespark.zip")  # the driver serves it to the executors
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(path)
        _shipped[sc.applicationId] = path
    return spark
