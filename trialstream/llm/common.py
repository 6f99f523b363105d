"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
#: Whole texts are large rows: so many of them are a few MB, where the usual 10,000 would be 100 MB in each of a task's buffers.
BATCH_ROWS = 1000
#: And so many bytes, which long texts reach first.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if where is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if where is None:
        where = getattr(context, "_trialstream_dir", None)
        if where is None:
            where = f"file://{tempfile.mkdtemp(prefix='trialstream-')}"
            context._trialstream_dir = where
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each Spark context; rows with texts go to them in batches of BATCH_ROWS and about BATCH_BYTES at most."""
    context = spark.sparkContext
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(str(spark.conf.get(name)).rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    if getattr(context, "_trialstream_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="trialstream-"), "trialstream_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    context._trialstream_shipped = True


def released(run):
    """A function over Arrow batches that gives freed memory back to the system when it ends: Python workers outlive their tasks."""

    @wraps(run)
    def until_the_end(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return until_the_end


def join_hot(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of side, which has one row for each key and how many rows have it, n (dropped); rows without a match stay.

    Keys that over a thousandth of all rows (total) have, a thousand keys at most, are broadcast, so that no task gets one of them whole.
    """
    one = side.drop("n")
    hot = F.broadcast(side.where(F.col("n") > total / 1000).drop("n").withColumn("_hot", F.lit(True)))
    first = rows.join(hot, key, "left")
    return first.where("_hot").drop("_hot").unionByName(first.where("_hot is null").select(*rows.columns).join(one, key, "left"))


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
