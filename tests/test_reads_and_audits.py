"""Reads by position, attribute audits and specified statistics on literal rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialstream.operators import audits as D
from trialstream.operators import inference as I
from trialstream.plans.queries import ORACLES, QUERIES
from trialstream.sources import indexed

NAN = float("nan")


def test_rows_at_keeps_the_order_of_the_request(spark, tmp_path):
    spark.createDataFrame([(f"v{i}", [float(i)] * (i % 3)) for i in range(40)], "name string, xs array<double>").coalesce(1).write.option("parquet.block.size", 256).parquet(f"{tmp_path}/t")
    rows = indexed.parquet_rows(spark, f"{tmp_path}/t", ["name", "xs"], file="file")
    wanted = [7, 3, 3, 99, None, -1, 39, 0]
    requests = spark.createDataFrame([(i, p) for p, i in enumerate(wanted)], "row_index bigint, position bigint").repartition(3)
    got = [(r["position"], r["name"], r["status"]) for r in indexed.rows_at(rows, requests).collect()]
    assert got == [(0, "v7", "found"), (1, "v3", "found"), (2, "v3", "found"), (3, None, "missing"), (4, None, "invalid"), (5, None, "invalid"), (6, "v39", "found"), (7, "v0", "found")]
    seen = indexed.map_batches(indexed.rows_at(rows, requests), lambda f: pd.DataFrame({"names": [",".join(f["name"])], "n": [sum(map(len, f["xs"]))]}), "names string, n bigint", batch=3)
    assert {tuple(r) for r in seen.select("batch", "names", "n").collect()} == {(0, "v7,v3,v3", 1), (2, "v39,v0", 0)}
    assert indexed.rows_at(rows, requests.limit(0)).collect() == []
    with pytest.raises(ValueError, match="positive"):
        indexed.map_batches(rows, lambda f: f, "n int", batch=0)



def test_positions_are_numbered_in_parts(spark):
    rows = [(None if k % 9 == 0 else k * 37 % 23, f"n{k * 11 % 101}" if k % 7 else None) for k in range(101)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(3)
    numbered = indexed.numbered(df, ["a", "b"], parts=8)
    want = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or "")))
    assert [(r["a"], r["b"]) for r in sorted(numbered.collect(), key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in numbered.collect()) == list(range(101))
    # no window takes all rows into one task
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert indexed.numbered(df.limit(0), ["a"]).collect() == []


def test_batches_get_a_row_once_for_each_group(spark):
    df = spark.createDataFrame([(k, [float(k)] * 3) for k in range(10)], "row_index bigint, xs array<double>")
    requests = spark.createDataFrame([(k, k * 7 % 13 - 1 if k % 5 else None) for k in range(200)], "position bigint, row_index bigint").repartition(3)
    reduce = lambda f: pd.DataFrame({"n": [len(f)], "total": [float(sum(x.sum() for x in f["xs"]))], "first": [f["position"].iloc[0]], "last": [f["position"].iloc[-1]]})
    schema = "n bigint, total double, first bigint, last bigint"
    want = indexed.map_batches(indexed.rows_at(df, requests), reduce, schema, batch=8).select("batch", "n", "total", "first", "last").collect()
    for batches in (1, 3, 100):
        got = indexed.batches_at(df, requests, reduce, schema, batch=8, batches=batches).select("batch", "n", "total", "first", "last").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 25
    assert indexed.batches_at(df, requests.where("row_index < 0"), reduce, schema).collect() == []


@pytest.mark.parametrize("name", ["vectors_in_batches", "rows_by_position"])
def test_places_are_stored_keys(spark, tmp_path, name):
    # tables of several files in no order: batches of a value close to 0, of nulls, of NaN, then of mixed rows, some absent, one there twice
    values = {8: [-(2.0**-24)], 19: None, 30: [1.0, NAN], 41: [None, 0.5], 52: [], 63: [2.0, None, -0.25]}
    vectors = [(k, values.get(k, [k / 4, k / -16])) for k in [*range(120), 41]]
    asked = [[1, 2, 3][k // 64] if k < 192 else k * 7 % 16 for k in range(300)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k, f"c{k}") for k in range(120)], "c_custkey bigint, c_name string").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(list(enumerate(asked)), "o_orderkey bigint, o_custkey bigint").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))
    assert len(got) == (5 if name == "vectors_in_batches" else 300)


def test_requests_by_source(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "source string, row_index bigint, v string")
    requests = indexed.numbered(spark.createDataFrame([("b", 0, 1), ("a", 1, 1), ("a", 0, 2), ("b", 1, 2)], "source string, row_index bigint, k int"), ["k"], by=["source"])
    assert [(r["source"], r["position"], r["v"], r["status"]) for r in indexed.rows_at(df, requests, by=["source"]).collect()] == [("a", 0, "y", "found"), ("a", 1, "x", "found"), ("b", 0, "z", "found"), ("b", 1, None, "missing")]


CONTRACT = [D.Attribute("window", "$.task.window", "array<double>", expected=(0.15, 0.75)), D.Attribute("id", "$.id", "bigint", expected_column="source"), D.Attribute("mode", "$.task.mode"), D.Attribute("rate", "$.rate", "double", required=False)]


def test_attribute_audit(spark):
    docs = {
        1: '{"task": {"window": [0.15, 0.75], "mode": "m"}, "id": 1, "rate": 3}', 2: '{"task": {"window": [0.15], "mode": 5}, "id": "2"}', 3: '{"task": ', 4: None, 5: '{"task": {"window": null}, "id": 6, "rate": "fast"}',
        6: '[1, 2]', 7: '{"task": {"window": ["a", "b"], "mode": ""}, "id": 7.5, "rate": null}',
    }
    df = spark.createDataFrame(list(docs.items()), "source int, doc string")
    got = {(r["source"], r["attribute"]): r["status"] for r in D.attribute_audit(df, CONTRACT, source="source", json="doc").collect()}
    want = {
        1: ["pass", "pass", "pass", "pass"], 2: ["differs", "wrong_type", "wrong_type", "absent"], 3: ["unreadable"] * 4, 4: ["unreadable"] * 4, 5: ["missing", "differs", "missing", "wrong_type"], 6: ["missing", "missing", "missing", "absent"],
        7: ["wrong_type", "wrong_type", "pass", "absent"],
    }
    assert got == {(s, a.name): x for s, row in want.items() for a, x in zip(CONTRACT, row, strict=True)}
    one = {r["attribute"]: (r["observed"], r["expected"]) for r in D.attribute_audit(df.where("source = 1"), CONTRACT, source="source", json="doc").collect()}
    assert one == {"window": ("[0.15,0.75]", "[0.15,0.75]"), "id": ("1", "1"), "mode": ('"m"', None), "rate": ("3", None)}
    rows = {(r["source"], r["path"], r["kind"]) for r in D.attribute_rows(df.where("source in (1, 3, 4)"), source="source", json="doc").collect()}
    assert rows == {(1, "$.task", "OBJECT"), (1, "$.task.window", "ARRAY"), (1, "$.task.mode", "STRING"), (1, "$.id", "BIGINT"), (1, "$.rate", "BIGINT"), (3, "$", "UNREADABLE")}


def test_violations_of_an_audit(spark):
    audit = spark.createDataFrame([(1, "a", "pass"), (1, "b", "absent"), (2, "a", "differs"), (2, "b", "pass"), (2, "b", "pass")], "source int, attribute string, status string")
    known = spark.createDataFrame([(2, "b")], "source int, attribute string")
    sources = spark.createDataFrame([(1,), (2,), (3,)], "source int")
    got = {r["rule"]: r["n_violations"] for r in D.audit_violations(audit, sources, source="source", by="attribute", known_absent=known).collect()}
    assert got == {"one_row": 1, "all_sources": 1, "passes:a": 1, "passes:b": 0, "known_absences": 2}


def test_signal_audit(spark):
    docs = [(1, '{"s": {"timestamps": 5, "data": 5}}'), (2, '{"s": {"timestamps": 5, "data": 4}}'), (3, '{"s": {"rate": 60.0, "data": 4}}'), (4, '{"s": {"data": 4}}'), (5, '{"s": {"timestamps": 5}}'), (6, "{}"), (7, "{"), (8, '{"s": 3}')]
    df = spark.createDataFrame(docs, "source int, doc string")
    audit = D.signal_audit(df, [D.Signal("s", "$.s"), D.Signal("t", "$.t", required=False)], source="source", json="doc")
    assert [r["status"] for r in audit.where("signal = 's'").orderBy("source").collect()] == ["pass", "length_mismatch", "pass", "no_clock", "missing_component", "missing", "unreadable", "missing"]
    assert [r["timing"] for r in audit.where("signal = 's'").orderBy("source").collect()] == ["timestamps", "timestamps", "rate", "none", "timestamps", None, None, None]
    s = D.signal_summary(audit, source="source").where("signal = 's'").first()
    assert (s["n_sources"], s["n_present"], s["n_passing"], s["n_failing"], s["n_unreadable"], s["n_with_timestamps"]) == (8, 5, 2, 6, 1, 3)


def test_clocks_and_dictionary(spark):
    columns = "source int, first_start double, last_stop double, passes boolean"
    a = spark.createDataFrame([(1, 0.0, 10.0, True), (2, 0.0, 10.0, True), (3, 0.0, 10.0, False)], columns)
    b = spark.createDataFrame([(1, 5.0, 12.0, True), (2, 11.0, 12.0, True)], columns)
    sessions = spark.createDataFrame([(1,), (2,), (3,)], "source int")
    c = D.combined_clocks(a, b, sessions, source="source", names=("trial", "shown"))
    assert {r["source"]: (r["passes"], r["ranges_overlap"], r["start_offset"]) for r in c.collect()} == {1: (True, True, 5.0), 2: (False, False, 11.0), 3: (False, None, None)}
    with pytest.raises(Exception, match="several rows"):
        D.combined_clocks(a.union(a), b, sessions, source="source", names=("trial", "shown")).collect()
    events = spark.createDataFrame([("start", "intervals"), ("frame", "frames"), ("x", "none")], "event string, scope string")
    read = lambda df: {r["event"]: (r["n_sessions"], r["n_passing"], r["status"]) for r in df.collect()}
    good = spark.createDataFrame([(i, True) for i in (1, 2, 3)], "source int, passes boolean")
    assert read(D.event_dictionary(events, c, good, source="source")) == {"start": (3, 1, "fail"), "frame": (3, 3, "pass"), "x": (3, None, "not_audited")}
    assert read(D.event_dictionary(events, c, source="source"))["frame"] == (3, None, "not_audited")


def test_specified_statistics(spark):
    rows = [("m", i, float(i), 2, 10) for i in range(6)] + [("m", 9, NAN, 5, 5), ("one", 1, 2.0, 1, 1)]
    df = spark.createDataFrame(rows, "metric string, subject int, value double, s int, t int")
    spec = [I.Statistic("b", "m", "c", "h", "x", family="f", tested=True), I.Statistic("a", "m", "c", "h", "x", null_value=2.5, family="f", tested=True), I.Statistic("d", "m", "c", "h", "x"), I.Statistic("e", "one", "c", "h", "x"), I.Statistic("z", "no", "c", "h", "x", family="f", tested=True)]
    got = {r["result_id"]: r for r in I.specified_statistics(df, spec, counts={"n_sessions": "s", "n_trials": "t"}, provenance={"code_version": "1"}, resamples=50).collect()}
    assert len(got) == 5 and {r["status"] for r in got.values()} == {"estimated", "point_only", "not_estimable"}
    assert (got["a"]["estimate"], got["a"]["n_mice"], got["a"]["n_sessions"], got["a"]["n_trials"], got["a"]["test_method"], got["a"]["n_resamples"]) == (2.5, 6, 12, 60, "sign_flip_exact", 64)
    assert got["a"]["p_value"] == 1.0 and got["b"]["p_value"] == pytest.approx(4 / 64) and got["b"]["adjusted_p_value"] == pytest.approx(8 / 64) and got["d"]["p_value"] is None and got["d"]["multiplicity_family"] is None
    assert (got["e"]["status_reason"], got["e"]["ci_low"], got["e"]["confidence_level"]) == ("one_unit", None, None) and (got["z"]["status_reason"], got["z"]["estimate"], got["z"]["n_mice"]) == ("no_values", None, 0)
    assert len({r["config_hash"] for r in got.values()}) == 1 and {r["code_version"] for r in got.values()} == {"1"}
    with pytest.raises(ValueError, match="unique"):
        I.specified_statistics(df, [spec[0], spec[0]])


def test_sample_status(spark):
    from trialstream.operators import blocks as B

    rows = [(1, 0, 1.0, 2.0), (1, 1, 1.0, 4.0), (2, 0, 1.0, 1.0), (2, 1, 2.0, 1.0), (3, 0, 3.0, 1.0), (3, 1, NAN, 1.0), (3, 2, 2.0, 1.0), (4, 0, NAN, 1.0)]
    clean, seen = B.prepared_samples(spark.createDataFrame(rows, "source int, k int, t double, v double"), source="source", index="k", time="t", value="v")
    assert {r["source"]: r["status"] for r in seen.collect()} == {1: "unavailable", 2: "pass", 3: "repaired", 4: "unavailable"}
    assert clean.where("source = 1").first()["v"] == 3.0 and seen.where("source = 3").first()["n_decreasing"] == 1
    assert clean.agg(F.count("*")).first()[0] == 5


def test_audit_is_dealt_by_source(spark, monkeypatch):
    from trialstream.operators import audits as D

    monkeypatch.setattr(D, "SOURCES_IN_PART", 2)
    sources = spark.createDataFrame([(k,) for k in range(7)], "source int")
    audit = spark.createDataFrame([(k, a, "pass" if k else "differs") for k in (0, 1, 1, 2, 3, 4, 5) for a in "xy"], "source int, attribute string, status string")
    out = D.audit_violations(audit, sources, source="source", by="attribute")
    assert {r["rule"]: r["n_violations"] for r in out.collect()} == {"one_row": 2, "all_sources": 1, "passes:x": 1, "passes:y": 1}
    assert "4), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
