"""Literal-row tests of edges: windows, missing values, cardinality, ties, exactness."""

from __future__ import annotations

import hashlib
import itertools
from fractions import Fraction
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialstream import sources as S
from trialstream.functions import image_contrast, image_identity, inverse_normal, is_sorted, lick_response, recording_day, response_window, session_asset, stabilized_response, unit_reasons, well_isolated, wilson_interval
from trialstream.operators import blocks as B
from trialstream.operators import cohorts as C
from trialstream.operators import expect as X
from trialstream.operators import inference as I
from trialstream.operators import joins as J
from trialstream.operators import models as M
from trialstream.operators import sessions as Z

NAN, INF = float("nan"), float("inf")


def values(df, column):
    return [r[column] for r in df.collect()]


def test_response_window_edges(spark):
    rows = [(1, 10.0, [10.15]), (2, 10.0, [10.75]), (3, 10.0, [10.75, 10.75, 11.0]), (4, 10.0, None), (5, NAN, [1.0]), (6, 10.0, [10.5, NAN]), (7, 10.0, [10.6, 10.5]), (8, 10.0, [])]
    df = spark.createDataFrame(rows, "id int, t double, licks array<double>").select("id", lick_response("t", "licks", 0.15, 0.75).alias("l")).select("id", "l.*").orderBy("id")
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["response"] is (10.15 - 10.0 > 0.15) and got[2]["response"] is True
    assert got[3]["n_duplicates"] == 1 and got[3]["n_unique"] == 2
    assert [got[i]["status"] for i in (4, 5, 6, 7, 8)] == ["missing", "invalid_event_time", "invalid", "unsorted", "pass"]
    assert got[8]["response"] is False and got[4]["response"] is None


def test_unit_quality(spark):
    rows = [(1, 0.1, 0.05, "good"), (2, 0.5, 0.05, "good"), (3, NAN, 0.05, "good"), (4, 0.1, -0.1, "good"), (5, 0.1, 0.05, None), (6, INF, None, "noise")]
    df = spark.createDataFrame(rows, "id int, isi_violations double, amplitude_cutoff double, quality string")
    got = df.select("id", well_isolated().alias("ok"), unit_reasons().alias("why")).orderBy("id").collect()
    assert [r["ok"] for r in got] == [True] + [False] * 5
    assert [r["why"] for r in got] == ["", "isi_violations_above_threshold", "isi_violations_invalid", "amplitude_cutoff_invalid", "quality_not_good", "isi_violations_invalid;amplitude_cutoff_invalid;quality_not_good"]


def test_inverse_normal(spark):
    ps = [1e-9, 0.001, 0.02, 0.02425, 0.3, 0.5, 0.9, 0.98, 0.999999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(inverse_normal(F.col("p")).alias("z")).collect()
    assert np.allclose([r["z"] for r in got[:-2]], [NormalDist().inv_cdf(p) for p in ps], rtol=2e-9, atol=2e-9)
    assert got[-1]["z"] is None and got[-2]["z"] is None


def test_small_expressions(spark):
    one = spark.range(1)
    assert one.select(is_sorted(F.lit(None).cast("array<double>")).alias("a"), is_sorted(F.array().cast("array<double>")).alias("b"), is_sorted(F.array(F.lit(2.0), F.lit(1.0))).alias("c")).first() == (None, True, False)
    assert one.select(image_identity(F.lit("im115_r-0.7")), image_contrast(F.lit("im115_r-0.7")), image_identity(F.lit("blank"))).first() == ("im115", 0.7, None)
    paths = {"sub-7/sub-7_ses-20240101T000000.nwb": True, "sub-7/sub-8_ses-20240101T000000.nwb": False, "sub-/sub-_ses-20240101T000000.nwb": False, "sub-7/sub-7_ses-20240101T00000.nwb": False, "sub-7/sub-7_ses-2024010100000T0.nwb": False, "x/sub-7/sub-7_ses-20240101T000000.nwb": False, "sub-7": False, "sub-7/sub-7_ses-20240101T000000.nwb.tmp": False, None: False}
    assert {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", session_asset("p")).collect()} == paths
    days = [("EPHYS_3", 3, 3), ("3", 4, None), ("x", 1, 1), ("ephys 2", None, 2), ("EPHYS-2", 2, 2), (None, None, None), ("0", None, None), (" 5 ", 5, 5), ("EPHYS", 2, 2)]
    assert [r[0] for r in spark.createDataFrame(days, "d string, n int, want int").coalesce(1).select(recording_day("d", "n")).collect()] == [d[2] for d in days]
    assert one.select(response_window(F.lit("[0.1, 0.7]")), response_window(F.lit("[0.7, 0.1]")), response_window(F.lit("oops"))).first() == ([0.1, 0.7], None, None)
    low, high = wilson_interval(F.lit(0), F.lit(0))
    assert one.select(low, high).first() == (None, None)
    v = one.select(stabilized_response(F.array(F.lit(1.0), F.lit(2.0)), F.lit(1.0), (0.0, 1.0), (-1.0, 0.0)).alias("v"), stabilized_response(F.array(F.lit(1.0)), F.lit(1.0), (0.0, 1.0), (-1.0, 0.0), F.lit(0.1), 0.25).alias("w")).first()
    assert v["v"] == pytest.approx(1.375**0.5 - 0.375**0.5) and np.isnan(v["w"])


def test_blocks_without_middle(spark):
    rows = [(1, 0, 0.0, 1.0, False), (1, 1, 1.0, 2.0, True), (1, 2, 2.0, 3.0, False), (2, 0, 0.0, 1.0, False), (2, 1, 1.0, 2.0, None)]
    got = B.label_blocks(spark.createDataFrame(rows, "source int, idx int, start_time double, stop_time double, no_reward boolean")).orderBy("source", "idx")
    assert values(got, "reward_block") == ["engaged_1", "no_reward", "engaged_2", "transition", "transition"]


def test_join_checked(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    with pytest.raises(J.CardinalityError):
        J.join_checked(a, b, ["k"], "left", "m:1")
    assert J.join_checked(a, b, ["k"], "left", "m:m").count() == 4
    assert J.join_checked(a, b.limit(1), ["k"], "left", "m:1").count() == 2


def test_nearest_ties_and_tolerance(spark):
    events = spark.createDataFrame([(1, 1, 5.0), (1, 2, 20.0), (2, 3, 1.0)], "s int, id int, t double")
    samples = spark.createDataFrame([(1, 4.0, 40.0), (1, 6.0, 60.0), (1, 10.0, 100.0)], "s int, t double, v double")
    got = J.nearest(events, samples, by=["s"], time="t", sample_time="t", value="v", tolerance=1.0)
    assert {r["id"]: r["nearest"] for r in got.collect()} == {1: 40.0, 2: None, 3: None}


def test_range_counts_match_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [(int(s), int(u), float(t)) for s, u, t in zip(rng.integers(0, 3, 300), rng.integers(0, 4, 300), np.round(rng.uniform(0, 50, 300), 1), strict=True)]
    events = [(int(s), i, float(t)) for i, (s, t) in enumerate(zip(rng.integers(0, 3, 40), np.round(rng.uniform(0, 50, 40), 1), strict=True))]
    p, e = spark.createDataFrame(points, "s int, u int, t double"), spark.createDataFrame(events, "s int, id int, e double")
    got = J.count_in_windows(p, e, by=["s"], point="t", event="e", windows={"a": (-2.5, 0.0), "b": (0.0, 4.0)}, unit=["u"], event_key=["id"]).collect()
    own = {(s, u) for s, u, _ in points}
    assert len(got) == sum(1 for s, _, _ in events for s2, _ in own if s == s2)
    at = {i: (s, t) for s, i, t in events}
    for r in got:
        s, c = at[r["id"]]
        assert r["a"] == sum(1 for x, u, t in points if x == s and u == r["u"] and c - 2.5 <= t < c)
        assert r["b"] == sum(1 for x, u, t in points if x == s and u == r["u"] and c <= t < c + 4.0)
    h = J.histogram_around(p, e, by=["s"], point="t", event="e", start=-1.0, width=0.5, bins=4, unit=["u"], event_key=["id"]).collect()
    for r in h:
        s, c = at[r["id"]]
        k = r["bin"]
        assert r["n"] == sum(1 for x, u, t in points if x == s and u == r["u"] and c + (-1.0 + k * 0.5) <= t < c + (-1.0 + (k + 1) * 0.5))


def test_frame_offsets_ambiguous(spark):
    anchors = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 5, "b"), (2, 1, 0, "a")], "s int, id int, af int, l string")
    frames = spark.createDataFrame([(1, 91200, "a"), (1, 91205, "b"), (1, 3, "a"), (2, 1, "a"), (2, 2, "a")], "s int, f int, l string")
    got = J.frame_offsets(anchors, frames, source="s", anchor_id="id", anchor_frame="af", frame="f", label="l").collect()
    assert [(r["s"], r["offset"]) for r in got] == [(1, 91200)]


def test_frame_offsets_share_one_exchange(spark):
    rng = np.random.default_rng(4)
    anchors = [(s, i, int(rng.integers(0, 9)), rng.choice(["a", "b", None])) for s in range(60) for i in range(int(rng.integers(1, 4)))] + [(None, 1, 0, "a")]
    frames = [(s, a + int(rng.integers(0, 2)), l) for s, _, a, l in anchors for _ in range(2)] + [(3, None, "a"), (70, 1, "a")]
    a = spark.createDataFrame(anchors, "s int, id int, af int, l string")
    out = J.frame_offsets(a, spark.createDataFrame(frames, "s int, f int, l string"), source="s", anchor_id="id", anchor_frame="af", frame="f", label="l")
    got, want = {r["s"]: r["offset"] for r in out.collect()}, {}
    for s in range(60):
        own, there = [x for x in anchors if x[0] == s], {(f, l) for s2, f, l in frames if s2 == s and l is not None}
        fits = [d for d in range(-20, 20) if all((x[2] + d, x[3]) in there for x in own) and len({x[2] for x in own}) == len(own)]
        if len(fits) == 1:
            want[s] = fits[0]
    assert got == want and len(want) > 3
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_holm_with_nulls(spark):
    df = spark.createDataFrame([(i, "f", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.002, None])], "i int, f string, p_value double")
    got = values(I.holm(df, family=["f"], order=["i"]).orderBy("i"), "adjusted_p")
    assert got[-1] is None and np.allclose(got[:-1], [0.03, 0.06, 0.06, 0.008])


def test_sign_flip_all_positive(spark):
    df = spark.createDataFrame([("g", i, 1.0 + i) for i in range(11)] + [("h", 0, 1.0)], "g string, u int, v double")
    got = {r["g"]: r for r in I.sign_flip(df, by=["g"], unit="u", value="v").collect()}
    assert got["g"]["p_value"] == 2 / 2**11 and got["h"]["p_value"] is None


def test_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(6)] + [("one", 0, 3.0), ("bad", 0, NAN)], "g string, u int, v double")
    a, b = (sorted(I.bootstrap_mean(d, by=["g"], unit="u", value="v", resamples=200).collect()) for d in (df, df.repartition(7)))
    assert a == b and [r["g"] for r in a] == ["g", "one"]
    assert a[0]["ci_low"] < 2.5 < a[0]["ci_high"] and a[1]["ci_low"] is None


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.1, False), (1, 0.5, True), (1, 0.5, False), (1, 0.9, True), (2, 1.0, True)], "g int, s double, t boolean")
    got = {r["g"]: r["auc"] for r in I.binary_auc(df, "s", "t", by=["g"]).collect()}
    assert got == {1: 0.875, 2: None}


def test_allocation_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(f"m{i}", fam, f"{fam}{k}", int(v)) for i in range(7) for fam, k, v in [("a", 0, rng.integers(0, 9)), ("a", 1, rng.integers(0, 9)), ("b", 0, rng.integers(0, 2))]]
    df = spark.createDataFrame(rows, "m string, family string, feature string, value bigint")
    best = C.allocate(df, C.AllocationConfig(confirmation=3), subject="m").first()
    table = {}
    for m, fam, f, v in rows:
        table.setdefault((fam, f), {})[m] = v

    def objective(inside):
        by = {}
        for (fam, _), t in table.items():
            x = np.array(list(t.values()), float)
            if x.var(ddof=1) > 0:
                d = np.mean([t[m] for m in inside]) - np.mean([v for m, v in t.items() if m not in inside])
                by.setdefault(fam, []).append(d * d / x.var(ddof=1))
        return round(float(np.mean([np.mean(v) for v in by.values()])), 9)

    scores = [objective(c) for c in itertools.combinations([f"m{i}" for i in range(7)], 3)]
    assert round(best["objective"], 9) == min(scores) and best["n_candidates"] == 35 and objective(best["members"]) == min(scores)


def test_unranked_subsets():
    for n, k in ((7, 3), (6, 6), (9, 1), (12, 5)):
        want = list(itertools.combinations(range(n), k))
        assert [tuple(x) for x in C.unranked(np.arange(len(want)), n, k)] == want


def exact_allocation(rows, k, seed):
    """(members, objective, worst, splits, ties, ties in both) over all splits, in fractions."""
    table = {}
    for m, fam, f, v in rows:
        table.setdefault((fam, f), {})[m] = Fraction(int(v))
    names, scored = sorted({r[0] for r in rows}), []
    table = {key: t for key, t in table.items() if len(set(t.values())) > 1}
    for inside in itertools.combinations(names, k):
        by = {}
        for (fam, _), t in table.items():
            mean = sum(t.values()) / len(t)
            d = sum(t[m] for m in inside) / k - sum(v for m, v in t.items() if m not in inside) / (len(t) - k)
            by.setdefault(fam, []).append(d * d / (sum((v - mean) ** 2 for v in t.values()) / (len(t) - 1)))
        scored.append((sum(sum(v) / len(v) for v in by.values()) / len(by), max(max(v) for v in by.values()), hashlib.sha256(f"{seed}|{','.join(inside)}".encode()).hexdigest(), inside))
    best = min(scored)
    return list(best[3]), float(best[0]), float(best[1]), len(scored), sum(x[0] == best[0] for x in scored), sum(x[:2] == best[:2] for x in scored)


def test_allocation_is_exact_with_ties(spark):
    rng = np.random.default_rng(8)
    schema = "m string, family string, feature string, value bigint"
    for n, k, top in ((8, 3, 2), (9, 4, 10**9), (6, 2, 2)):
        rows = [(f"m{i:02d}", fam, f"{fam}{j}", int(rng.integers(0, top))) for i in range(n) for fam, j in (("a", 0), ("a", 1), ("b", 0), ("c", 0))]
        rows += [(f"m{i:02d}", "c", "constant", 4) for i in range(n)]
        for batch in (1 << 14, 5):
            got = C.allocate(spark.createDataFrame(rows, schema), C.AllocationConfig(confirmation=k, batch=batch), subject="m").first()
            members, objective, worst, *counts = exact_allocation(rows, k, "20240101")
            assert got["members"] == members and [got["n_candidates"], got["n_tied"], got["n_tied_twice"]] == counts
            assert got["objective"] == pytest.approx(objective, abs=1e-11) and got["worst"] == pytest.approx(worst, abs=1e-11)


def test_allocation_refuses_bad_features(spark):
    schema = "m string, family string, feature string, value bigint"
    rows = [(f"m{i}", "a", "x", i) for i in range(5)]
    for bad, match in (([(m, a, f, 1) for m, a, f, _ in rows], "varies"), (rows + rows[:1], "one value"), (rows + [("m0", "a", "y", 1), ("m1", "a", "y", 2)], "one value"), (rows[:2], "can't be split")):
        with pytest.raises(ValueError, match=match):
            C.allocate(spark.createDataFrame(bad, schema), C.AllocationConfig(confirmation=2), subject="m")
    with pytest.raises(ValueError, match="too many"):
        C.allocate(spark.createDataFrame(rows, schema), C.AllocationConfig(confirmation=2, max_splits=9), subject="m")


def test_allocation_inputs(spark):
    good = [(f"s{i}", f"m{i // 2}", "f") for i in range(8)]
    quality = [(s, m, i % 2 == 0) for i, (s, m, _) in enumerate(good)]

    def broken(sessions, quality, **more):
        frames = spark.createDataFrame(sessions, "session string, subject string, sex string"), spark.createDataFrame(quality, "session string, subject string, is_good_session boolean")
        return {r["rule"] for r in C.input_violations(*frames, session="session", subject="subject", constant=["sex"], subjects=4, **more).collect() if r["n_violations"]}

    assert broken(good, quality) == set()
    assert broken(good, quality[:-1]) == {"same_sessions", "same_subjects"}
    assert broken([*good[:-1], ("s7", "m3", "g")], quality) == {"constant_metadata"}
    for name in (None, "", "   "):
        assert "named_subject" in broken([("s0", name, "f"), *good[1:]], quality) and "named_quality_subject" in broken(good, [("s0", name, True), *quality[1:]])
    assert broken([*good, good[0]], quality) == {"unique_session"}
    assert broken(good, [(s, m, False if m == "m0" else g) for s, m, g in quality]) == {"eligible_subjects"}
    assert broken([*good[:-1], ("s7", "m3", None)], quality) == {"known_sex", "constant_metadata"}
    assert "known_selection" in broken(good, [(*quality[0][:2], None), *quality[1:]])
    with pytest.raises(TypeError, match="boolean"):
        C.input_violations(spark.createDataFrame(good, "session string, subject string, sex string"), spark.createDataFrame([("s", "m", 1)], "session string, subject string, is_good_session int"), session="session", subject="subject", constant=[])


def test_permutation_keeps_sessions(spark):
    rng = np.random.default_rng(3)
    rows = [(s, s % 3, u, "ab"[u % 2] if u % 5 else None, float(rng.normal()) if u % 7 else None) for s in range(6) for u in range(12)]
    schema = "session int, subject int, unit int, label string, value double"
    names = {"session": "session", "subject": "subject", "unit": "unit", "label": "label", "value": "value"}
    got = {(r["label"], r["rep"]): r["mean"] for r in I.permutation_null(spark.createDataFrame(rows, schema).repartition(5), **names, permutations=7, seed=2).collect()}
    assert len(got) == 14
    for rep in range(7):
        means = {}
        for s in range(6):
            own = [r for r in rows if r[0] == s]
            order = sorted(own, key=lambda r: hashlib.md5(f"2|{rep}|{s}|{r[2]}".encode()).hexdigest())
            for label in "ab":
                v = [o[4] for r, o in zip(own, order, strict=True) if r[3] == label and o[4] is not None]
                means.setdefault((label, s % 3), []).append(np.mean(v))
        for label in "ab":
            assert got[label, rep] == pytest.approx(np.mean([np.mean(m) for (lab, _), m in means.items() if lab == label]))
    with pytest.raises(Exception, match="several subjects"):
        I.permutation_null(spark.createDataFrame([(1, 1, 1, "a", 1.0), (1, 2, 2, "a", 1.0)], schema), **names, permutations=2).collect()


def test_ridge_recovers(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i % 3, *map(float, x), float(2 * x[0] - x[1] + 1 + rng.normal(0, 0.05))) for i, x in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "g int, fold int, x0 double, x1 double, y double")
    got = M.nested_ridge(M.moments(df, ["x0", "x1"], "y", by=["g", "fold"]), by=["g"], folds=3).first()
    assert got["r2"] > 0.98 and np.allclose(got["coefficients"], [1, 2, -1], atol=0.1)


def test_contract_and_statistics(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    assert S.project_contract(df, {"id": "bigint"}, {"flag": "boolean"}).dtypes == [("id", "bigint"), ("flag", "boolean")]
    with pytest.raises(S.ContractError):
        S.project_contract(df, {"missing": "int"})
    with pytest.raises(X.ExpectationError):
        X.statistics_table(df)
    good = spark.createDataFrame([("r", "primary", "estimated", 1.0, 0.5, 0.1), ("s", "primary", "pending", None, None, None)], "result_id string, tier string, status string, estimate double, ci_low double, ci_high double")
    broken = {(r["result_id"], r["rule"]) for r in X.broken_rules(X.statistics_table(good), X.statistics_rules(), "result_id").collect()}
    assert broken == {("r", "interval_order"), ("r", "interval_companions"), ("s", "reason_given")}
    with pytest.raises(X.ExpectationError):
        X.enforce(X.expect_unique(df.union(df), ["id"]))
    X.enforce(X.expect_equal(df, df))


def test_equal_weight_ignores_row_counts(spark):
    rows = [("m", 1, 1.0)] * 9 + [("m", 2, 0.0), ("m", 3, NAN)]
    got = Z.equal_weight_means(spark.createDataFrame(rows, "subject string, source int, v double"), ["v"], by=["subject"]).first()
    assert got["v"] == 0.5 and got["n_v"] == 2 and got["n_units"] == 3


def test_scan_and_write(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "idx bigint, v double")
    for name in ("a", "b"):
        S.write_table(df.coalesce(1), f"{tmp_path}/{name}/intervals/trials.parquet")
    got = S.scan_table(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], "/intervals/trials", ["v", "idx", "v"], index="idx")
    assert got.columns == ["v", "idx", "_source", "_table", "_index"] and got.count() == 10 and got.select("_source").distinct().count() == 2
    S.write_table(df, f"{tmp_path}/out.csv")
    assert spark.read.csv(f"{tmp_path}/out.csv", header=True).count() == 5


def test_tree_paths_go_down_to_every_node_or_fail(spark):
    edges = spark.createDataFrame([(0, None), *((i, i - 1) for i in range(1, 6))], "node int, parent int")
    got = {r["node"]: r["path"] for r in J.tree_paths(edges, node="node", parent="parent", max_depth=5).collect()}
    assert got == {i: list(range(i + 1)) for i in range(6)}
    with pytest.raises(Exception, match="deeper than max_depth"):
        J.tree_paths(edges, node="node", parent="parent", max_depth=4).collect()


def test_evenly_spaced_places(spark):
    sizes = {"a": 7, "b": 12, "c": 61, "d": 30_000}
    for groups in (("a", "b", "c"), ("b", "c"), ("c",), ("c", "d")):
        df = spark.createDataFrame([(0, g, k) for g in groups for k in range(sizes[g])], "s int, g string, k int")
        least = min(sizes[g] for g in groups)
        chosen = B.evenly_spaced(df, by=["s"], group="g", order=["k"])
        assert sorted((r["g"], r["k"]) for r in chosen.collect()) == sorted((g, (2 * i + 1) * sizes[g] // (2 * least)) for g in groups for i in range(least))
        # places follow by arithmetic; no row searches a list of them
        assert "array_contains" not in chosen._jdf.queryExecution().optimizedPlan().toString()


def test_counts_need_no_exchange_after_the_pairs(spark):
    p = spark.createDataFrame([("a", u, float(t)) for u, t in (("x", 0), ("x", 9), ("x", 10), ("y", 14), ("y", 21), (None, 11))] + [("b", "x", 3.0), ("a", "z", None)], "s string, u string, t double")
    e = spark.createDataFrame([("a", 1, 10.0, None), ("a", 2, 20.0, 5), ("a", 3, None, 5), ("b", 4, 50.0, 5)], "s string, id int, e double, v int")
    common = {"by": ["s"], "point": "t", "event": "e", "unit": ["u"], "event_key": ["id", "v"]}
    counted = J.count_in_windows(p, e, windows={"n": (-5.0, 5.0)}, **common)
    got = {(r["id"], r["u"]): r["n"] for r in counted.collect()}
    # a null in the event's key or in the unit is a value like others
    assert got == {(i, u): {(1, "x"): 2, (1, "y"): 1, (1, None): 1, (2, "y"): 1}.get((i, u), 0) for i in (1, 2, 3) for u in ("x", "y", "z", None)} | {(4, "x"): 0}
    rows = J.histograms_around(p, e, start=-5.0, width=2.5, bins=4, **common)
    assert {(r["id"], r["u"]): r["counts"] for r in rows.where("s = 'a' and id < 2").collect()} == {(1, "x"): [0, 1, 1, 0], (1, "y"): [0, 0, 0, 1], (1, None): [0, 0, 1, 0], (1, "z"): [0] * 4}
    for df in (counted, rows):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Join")]


def test_exposure_in_given_partitions(spark):
    df = spark.createDataFrame([("s", "x" if k % 3 else None, k) for k in range(9)], "source string, image string, k int")
    got = B.exposure_index(df, "image", by=["source"], order=["k"], parts=5)
    assert [r["exposure"] for r in got.orderBy("k").collect()] == [None, 1, 2, None, 3, 4, None, 5, 6]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "5), REPARTITION_BY_NUM" in plan
