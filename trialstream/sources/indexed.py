"""Reads of table rows by position: in the order of a request, with repeats, and with what is missing reported."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..shipping import ship


def parquet_rows(spark: SparkSession, path: str, columns: list[str] | None = None, *, index: str = "row_index", file: str | None = None) -> DataFrame:
    """Rows of a Parquet table with index, their place in their file as Parquet itself counts it (from 0), and, if file is given, the file's name."""
    df = spark.read.parquet(path)
    more = [F.col("_metadata.row_index").alias(index)] + ([F.col("_metadata.file_name").alias(file)] if file else [])
    return df.select(*(columns or df.columns), *more)


def numbered(requests: DataFrame, order: list[str], *, by: list[str] | None = None, position: str = "position", parts: int = 64) -> DataFrame:
    """requests with their position from 0 in the given order, within by.

    Without by, rows are numbered within parts that follow each other in the order, plus the rows of the parts before; the parts' bounds come from
    a sample, which moves work but no position. The bounds and the sizes of the parts pass through the driver.
    """
    if by:
        return requests.withColumn(position, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    some = requests.select(*order).orderBy(F.xxhash64(*order)).limit(32 * parts).distinct().orderBy(*order).collect()
    kinds = [requests.schema[c].dataType for c in order]

    def at(values: Iterable[Column]) -> Column:
        own = [v.cast(t).alias(c) for v, t, c in zip(values, kinds, order, strict=True)]
        return own[0] if len(own) == 1 else F.struct(*own)

    bounds = [some[i] for i in sorted({len(some) * k // parts for k in range(1, parts)} - {0})]

    def part(low: int, high: int) -> Column:
        """How many of the bounds aren't above the row, which is behind the first low ones and before those from high on; a null comes first."""
        if low == high:
            return F.lit(low)
        k = (low + high) // 2
        return F.when(at(map(F.col, order)) >= at(map(F.lit, bounds[k])), part(k + 1, high)).otherwise(part(low, k))

    dealt = requests.withColumn("_part", part(0, len(bounds)))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    before = F.array(*[F.lit(sum(n for k, n in sizes.items() if k < i)).cast("bigint") for i in range(len(bounds) + 1)])
    own = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn(position, before[F.col("_part")] + F.row_number().over(own) - 1).drop("_part")


def rows_at(df: DataFrame, requests: DataFrame, *, index: str = "row_index", position: str = "position", by: list[str] | None = None) -> DataFrame:
    """A row for each request (by, index, position): the request with df's columns and status, ordered by by and position.

    Repeated indices give repeated rows. status: found; missing, if df has no such row (its columns are null); invalid for a null or negative
    index. The range of requested indices filters df before the join, so that row groups outside of it aren't read where index is a stored column.
    """
    found = requests.join(_near(df, requests, index).withColumn("_found", F.lit(True)), [*(by or []), index], "left")
    status = F.when(F.col(index).isNull() | (F.col(index) < 0), "invalid").when(F.col("_found"), "found").otherwise("missing")
    return found.withColumn("status", status).drop("_found").orderBy(*(by or []), position)


def _near(df: DataFrame, requests: DataFrame, index: str) -> DataFrame:
    """Rows of df in the range of requested indices."""
    span = requests.agg(F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    return df.where(F.col(index).between(max(span["lo"], 0), span["hi"])) if span["hi"] is not None else df.limit(0)


def batches_at(df: DataFrame, requests: DataFrame, reduce: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, index: str = "row_index", position: str = "position", batch: int = 64, by: list[str] | None = None, batches: int = 256) -> DataFrame:
    """What map_batches gives for the rows of rows_at, without a copy of a row for each request: batches next to each other lie in one group, to which a row of df goes once."""
    if batch < 1 or batches < 1:
        raise ValueError("batch and batches must be positive")
    ship(df.sparkSession)
    keys = [*(by or []), "batch"]
    kinds = ", ".join([*(f"{c} {requests.schema[c].dataType.simpleString()}" for c in by or []), "batch bigint", schema])
    dealt = requests.withColumn("batch", F.floor(F.col(position) / batch)).withColumn("_group", F.floor(F.col("batch") / batches))
    group, on = [*(by or []), "_group"], [*(by or []), index]
    wanted = dealt.select(*[F.col(c).alias(c) for c in [*group, index]]).distinct()
    rows = wanted.join(_near(df, requests, index), on)

    def run(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        whole = asked.merge(found.drop(columns="_group"), on=on).drop(columns="_group").sort_values(position, kind="stable")
        return pd.concat([reduce(own).assign(**{c: own[c].iloc[0] for c in keys}) for _, own in whole.groupby("batch", sort=False)] or [pd.DataFrame(columns=names)], ignore_index=True)

    names = [f.name for f in StructType.fromDDL(kinds)]
    return dealt.groupBy(*group).cogroup(rows.groupBy(*group)).applyInPandas(run, kinds)


def map_batches(rows: DataFrame, reduce: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, batch: int = 64, position: str = "position", by: list[str] | None = None) -> DataFrame:
    """reduce of each batch of rows that lie next to each other in the request, as rows_at returns them; a batch holds so many at most, in order.

    reduce gets the batch's rows by position; its result gets by and batch beside.
    """
    if batch < 1:
        raise ValueError("batch must be positive")
    ship(rows.sparkSession)
    keys = [*(by or []), "batch"]
    kinds = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by or []), "batch bigint", schema])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = reduce(frame.sort_values(position))
        return out.assign(**{c: frame[c].iloc[0] for c in keys})

    dealt = rows.where("status = 'found'").withColumn("batch", F.floor(F.col(position) / batch))
    return dealt.groupBy(*keys).applyInPandas(run, kinds)
