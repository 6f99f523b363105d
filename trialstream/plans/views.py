"""Views of the test tables as trials, units, spikes and estimates; in Spark, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.blocks import label_blocks

EPOCH = 1704067200.0
DAY = 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame, rows: int = 500_000) -> int:
    """A number of partitions that grows with a scanned table, so that a task sorts about so many of its rows."""
    return -(-df.count() // rows) or 1


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials of sessions (users) of 27 subjects; the middle of the month is the block without reward."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - EPOCH
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), (F.col("user_id") % 27).alias("subject"), (F.row_number().over(own) - 1).alias("idx"), F.col("event_id").alias("id"), start.alias("start_time"),
        F.coalesce(F.lead(start).over(own), start + 60).alias("stop_time"), start.alias("change_time"), F.dayofmonth("ts").between(11, 20).alias("no_reward"), F.col("event_type").isin("view", "purchase").alias("go"),
        (F.col("event_type") == "click").alias("catch"), (F.col("event_type") == "error").alias("aborted"), (F.col("event_type") == "signup").alias("auto_rewarded"), (F.col("value") > 20).alias("response"), F.col("value"), F.col("event_type"),
    )


TRIALS = f"""ev AS (SELECT *, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 - {EPOCH} AS st, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    lead(epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 - {EPOCH}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
trials AS (SELECT user_id AS source, user_id % 27 AS subject, idx, event_id AS id, st AS start_time, coalesce(nx, st + 60) AS stop_time, st AS change_time, day(ts) BETWEEN 11 AND 20 AS no_reward,
    event_type IN ('view', 'purchase') AS go, event_type = 'click' AS "catch", event_type = 'error' AS aborted, event_type = 'signup' AS auto_rewarded, value > 20 AS response, value, event_type FROM ev),
edges AS (SELECT source AS s0, min(CASE WHEN no_reward THEN start_time END) AS f0, max(CASE WHEN no_reward THEN stop_time END) AS l0 FROM trials GROUP BY 1),
labelled AS (SELECT t.*, CASE WHEN f0 IS NULL THEN 'transition' WHEN no_reward THEN 'no_reward' WHEN start_time < f0 THEN 'engaged_1' WHEN start_time >= l0 THEN 'engaged_2' ELSE 'transition' END AS reward_block
    FROM trials t JOIN edges ON s0 = source)"""

CONDITIONED = """cond AS (SELECT *, CASE WHEN go THEN 'go' ELSE 'catch' END AS condition FROM labelled WHERE go <> "catch" AND NOT aborted AND NOT auto_rewarded AND response IS NOT NULL)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_blocks(trials(spark, sf_dir))


def licks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled trials with lick_times: the session's events of the next two days, as seconds after the event in units of a day."""
    own = Window.partitionBy("source").orderBy("start_time").rangeBetween(0, int(2 * DAY))
    t = labelled(spark, sf_dir)
    return t.withColumn("lick_times", F.transform(F.sort_array(F.collect_list("start_time").over(own)), lambda x: x / DAY)).withColumn("lick_event", F.col("change_time") / DAY - 0.1)


LICKS = f"""licks AS (SELECT t.*, list_transform(list_sort(list(start_time) OVER (PARTITION BY source ORDER BY start_time RANGE BETWEEN CURRENT ROW AND {2 * DAY} FOLLOWING)), lambda x: x / {DAY}) AS lick_times,
    change_time / {DAY} - 0.1 AS lick_event FROM labelled t)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as units of 20 sources, with quality values from the vector."""
    v = table(spark, sf_dir, "embeddings")
    e = lambda i: F.element_at("embedding", i).cast("double")
    return v.select(
        (F.col("vec_id") % 20).alias("source"), (F.col("vec_id") % 20 % 7).alias("subject"), F.col("vec_id").alias("unit"), F.col("label").alias("region"), (F.col("vec_id") % 16).alias("peak_channel"), F.abs(e(1) * 2).alias("isi_violations"),
        F.when(F.col("vec_id") % 11 == 0, F.lit(None)).otherwise(F.abs(e(2)) / 2).alias("amplitude_cutoff"), F.when(F.col("vec_id") % 5 == 0, "noise").otherwise("good").alias("quality"), e(3).alias("weight"), F.col("embedding"),
    )


UNITS = """units AS (SELECT vec_id % 20 AS source, vec_id % 20 % 7 AS subject, vec_id AS unit, label AS region, vec_id % 16 AS peak_channel, abs(CAST(embedding[1] AS DOUBLE) * 2) AS isi_violations,
    CASE WHEN vec_id % 11 = 0 THEN NULL ELSE abs(CAST(embedding[2] AS DOUBLE)) / 2 END AS amplitude_cutoff, CASE WHEN vec_id % 5 = 0 THEN 'noise' ELSE 'good' END AS quality, CAST(embedding[3] AS DOUBLE) AS weight FROM embeddings)"""


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, unit, t): events as points of units (event types)."""
    return trials(spark, sf_dir).select("source", F.col("event_type").alias("unit"), F.col("start_time").alias("t"))


def spike_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(spark, sf_dir).groupBy("source", "unit").agg(F.sort_array(F.collect_list("t")).alias("spike_times"))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials of sessions (customers) of subjects (nations): block by year, value by price."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    y = F.year("o_orderdate")
    block = F.when(y <= 1994, "engaged_1").when(y <= 1996, "no_reward").otherwise("engaged_2")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("subject"), F.col("c_mktsegment").alias("segment"), F.col("o_orderkey").alias("id"), block.alias("reward_block"), (F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderpriority") < "3").alias("response"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("placed"),
    )


ESTIMATES = """estimates AS (SELECT c_custkey AS source, c_nationkey AS subject, c_mktsegment AS segment, o_orderkey AS id, CASE WHEN year(o_orderdate) <= 1994 THEN 'engaged_1' WHEN year(o_orderdate) <= 1996 THEN 'no_reward' ELSE 'engaged_2' END AS reward_block,
    o_totalprice / 1000 AS score, o_orderpriority < '3' AS response, o_orderstatus AS status, o_orderdate AS placed FROM orders JOIN customer ON o_custkey = c_custkey)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as presentations of images (parts) to sessions (suppliers), frame by order key and line."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    token = F.concat(F.lit("im"), F.col("p_size"), F.lit("_r-"), F.when(F.col("p_size") % 2 == 0, "1.0").otherwise("0.7"))
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start_frame"), F.col("l_linenumber").alias("idx"), token.alias("image_name"), F.col("p_size"), (F.col("l_returnflag") == "R").alias("is_change"), (F.col("l_linestatus") == "O").alias("omitted"))


IMAGES = """images AS (SELECT l_suppkey AS source, l_orderkey * 10 + l_linenumber AS start_frame, l_linenumber AS idx, 'im' || p_size || '_r-' || CASE WHEN p_size % 2 = 0 THEN '1.0' ELSE '0.7' END AS image_name, p_size,
    l_returnflag = 'R' AS is_change, l_linestatus = 'O' AS omitted FROM lineitem JOIN part ON l_partkey = p_partkey)"""
