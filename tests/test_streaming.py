from __future__ import annotations

from pyspark.sql import functions as F

from trialstream.streaming import deduplicated, response_counts


def test_response_counts(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:10", 10.0, [10.5]), (1, "a", "2024-01-01 00:00:10", 10.0, [10.5]), (2, "a", "2024-01-01 00:06:00", 20.0, [20.05]), (3, "b", "2024-01-01 00:06:30", 5.0, [5.2])]
    df = spark.createDataFrame(rows, "id int, source string, ts string, t double, licks array<double>").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    feed = deduplicated(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), keys=["id"], time="ts")
    out = response_counts(df.dropDuplicates(["id"]), source="source", time="ts", event="t", licks="licks")
    assert sorted((r["source"], r["n_trials"], r["n_responses"]) for r in out.collect()) == [("a", 1, 0), ("a", 1, 1), ("b", 1, 1)]
    query = feed.writeStream.format("memory").queryName("unique_trials").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("unique_trials").count() == 3
