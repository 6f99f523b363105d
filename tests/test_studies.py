"""Literal cases of scores around transitions, response classes and windowed responses."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trialstream.operators import responses as P
from trialstream.operators import scores as SC

NAN, INF = float("nan"), float("inf")


def session(name, withheld=0):
    spans = [(30, "engaged_1", 0.5), (50, "engaged_1", 0.5), (80, "engaged_1", 0.5), (100, "no_reward", -0.5), (130, "no_reward", -0.5), (150, "no_reward", -0.5), (180, "no_reward", -0.5), (200, "engaged_2", 0.4)]
    rows = [(name, float(t + 4 * i), b, v) for t, b, v in spans for i in range(5 - withheld * (t == 100))]
    # on the right side in time, in the wrong state
    return [*rows, (name, 96.0, "no_reward", -100.0), (name, 104.0, "engaged_1", 100.0), (name, 104.0, "no_reward", NAN), (name, None, "no_reward", 7.0)]


def bounds(name, subject, used=True):
    return [(name, subject, "withdrawal", "engaged_1", "no_reward", -1, 100.0, 50.0, used), (name, subject, "restoration", "no_reward", "engaged_2", 1, 200.0, 150.0, used)]


SCORES, BOUNDS = "source string, change_time double, reward_block string, score double", "source string, subject string, transition string, pre_block string, post_block string, direction int, real_time double, pseudo_time double, used boolean"
CONFIG = SC.ScoreConfig(trajectory_window=60, bin_width=20, effect_window=30, min_trials=5)


def test_transition_scores(spark):
    scores = spark.createDataFrame(session("a") + session("b", 1) + session("c"), SCORES)
    marks = spark.createDataFrame([*bounds("a", "x"), *bounds("b", "x"), *bounds("c", "y", False), ("d", "y", "withdrawal", "engaged_1", "no_reward", -1, None, INF, True)], BOUNDS)
    t = SC.transition_scores(scores, marks, CONFIG, included="used")
    steps = {(r["source"], r["transition"], r["anchor"]): r for r in t.session_steps.collect()}
    assert len(steps) == 14
    one = steps["a", "withdrawal", "real"]
    assert (one["n_pre"], one["n_post"], one["signed_step"], one["status"]) == (5, 5, pytest.approx(1.0), "pass")
    assert steps["a", "restoration", "real"]["signed_step"] == pytest.approx(0.9) and steps["a", "restoration", "pseudo"]["signed_step"] == 0
    assert (steps["b", "withdrawal", "real"]["status"], steps["b", "withdrawal", "real"]["signed_step"], steps["b", "withdrawal", "real"]["n_post"]) == ("insufficient_trials", None, 4)
    assert {steps[k]["status"] for k in steps if k[0] in "cd"} == {"invalid_boundary"}
    contrasts = {(r["source"], r["transition"]): (r["real_minus_pseudo"], r["status"]) for r in t.session_contrasts.collect()}
    assert contrasts["a", "withdrawal"] == (pytest.approx(1.0), "pass") and contrasts["b", "withdrawal"] == (None, "insufficient_anchor_support")
    subjects = {(r["subject"], r["transition"]): (r["n_sessions"], r["real_minus_pseudo"]) for r in t.subject_contrasts.collect()}
    assert subjects == {("x", "withdrawal"): (1, pytest.approx(1.0)), ("x", "restoration"): (2, pytest.approx(0.9))}
    bins = {r["bin"]: r for r in t.session_trajectories.where("source = 'a' and transition = 'withdrawal' and anchor = 'real'").collect()}
    assert sorted(bins) == [-3, -2, -1, 0, 1, 2] and (bins[0]["mean_score"], bins[0]["n_trials"], bins[0]["expected_block"]) == (-0.5, 5, "no_reward")
    assert (bins[-1]["mean_score"], bins[-1]["n_trials"], bins[-1]["bin_center"]) == (0.5, 5, -10.0)
    assert {r["status"] for r in t.session_trajectories.where("source = 'd'").collect()} == {"invalid_boundary"} and t.session_trajectories.count() == 14 * 6
    assert t.subject_trajectories.where("subject = 'y'").isEmpty() and t.subject_steps.where("subject = 'x' and transition = 'withdrawal' and anchor = 'real'").first()["n_sessions"] == 1




def test_several_boundaries_are_an_error(spark):
    marks = spark.createDataFrame(bounds("a", "x") + bounds("a", "x"), BOUNDS)
    with pytest.raises(Exception, match="several boundaries"):
        SC.transition_scores(spark.createDataFrame(session("a"), SCORES), marks, CONFIG).session_steps.collect()


TRIALS = "unit int, half int, early double, late double, action double, responded boolean"


def test_response_classes(spark):
    rows = []
    for i in range(8):
        half, responded = i % 2, i % 4 < 2
        for unit, (e, late, a) in enumerate([(4.0, 0.5, 0.3), (0.5, -5.0, 0.2), (0.2, 0.3, 6.0), (1.0 - 2 * half, 0.0, 0.5), (2.0, 1.0, 9.0 if not responded else 0.1), (0.0, 0.0, 0.0), (3.0 if half else 1.0, 2.0, 0.0), (NAN if half else 1.0, 0.1, 0.2)]):
            rows.append((unit, half, e, late, a, responded))
    got = {r["unit"]: r for r in P.response_classes(spark.createDataFrame(rows, TRIALS), by=["unit"]).collect()}
    assert [got[u]["response_class"] for u in range(8)] == ["early_sensory", "late_prelick", "action_related", "continuous_only", "early_sensory", "continuous_only", "continuous_only", "continuous_only"]
    assert [got[u]["sign"] for u in range(8)] == [1, -1, 1, None, 1, None, None, None]
    assert [got[u]["is_stable"] for u in range(8)] == [True, True, True, False, True, False, False, False]
    assert got[0]["margin"] == pytest.approx(3.5 / 4) and (got[6]["half_0_class"], got[6]["half_1_class"], got[6]["margin"]) == ("late_prelick", "early_sensory", pytest.approx(1 / 3))
    assert got[7]["half_1_class"] is None and got[7]["margin"] is None and got[7]["early_response"] == 1.0 and got[4]["action_response"] == pytest.approx(0.1)
    units = P.response_classes(spark.createDataFrame(rows, TRIALS), by=["unit"]).withColumns({"subject": F.lit(1), "session": F.col("unit") % 2})
    s = P.class_stability(units, by=["subject"], session="session").first()
    assert (s["n_sessions"], s["n_units"], s["n_stable_units"], s["n_early_sensory"], s["stable_fraction"]) == (2, 8, 4, 2, 0.5)


def test_windowed_responses(spark):
    rows = [(1, 0, b, 1 if b < 2 else 3, None) for b in range(4)] + [(2, 0, b, 3 if b > 3 else 1, 0.31) for b in range(6)] + [(3, 0, b, 1, 0.15) for b in range(6)]
    df = spark.createDataFrame(rows, "trial int, unit int, bin int, n int, stop double")
    plain = P.windowed_responses(df.where("trial = 1"), by=["trial", "unit"], start=-0.2, width=0.1, response=(0.0, 0.2), baseline=(-0.2, 0.0)).first()["response"]
    assert plain == pytest.approx((math.sqrt(6 + 3 / 8) - math.sqrt(2 + 3 / 8)) / math.sqrt(0.2))
    cut = {r["trial"]: r["response"] for r in P.windowed_responses(df.where("trial > 1"), by=["trial", "unit", "stop"], start=-0.2, width=0.1, response=(0.15 - 1e-9, 0.4), baseline=(-0.2, 0.0), stop="stop").collect()}
    assert cut[2] == pytest.approx((math.sqrt(4 + 3 / 8) - math.sqrt(2 + 3 / 8)) / math.sqrt(0.2)) and cut[3] is None


def test_profiles(spark):
    rows = [(1, u, t, b, k, n) for u in (1, 2) for t, b in ((1, "e"), (2, "e"), (3, "r")) for k, n in enumerate((1, 1, 4 + t, 2))]
    bins = spark.createDataFrame(rows, "source int, unit int, trial int, block string, bin int, n int")
    units = spark.createDataFrame([(1, 1, 7, 1.0, True, "g"), (1, 2, 7, -1.0, False, "g")], "source int, unit int, subject int, sign double, is_stable boolean, response_group string")
    profiles = P.unit_profiles(bins, units, session="source", unit="unit", block="block", start=-1.0, width=0.5, baseline=(-1.0, 0.0))
    one = profiles.where("unit = 2 and block = 'e' and bin = 2").first()
    assert (one["mean_rate"], one["evoked_rate"], one["sign_aligned_rate"], one["n_trials"], one["bin_center"]) == (11.0, 9.0, -9.0, 2, 0.25) and one["rate_deviation"] == pytest.approx(math.sqrt(0.5) / 0.5)
    sessions, subjects = P.group_profiles(profiles, session="source", subject="subject", unit="unit", block="block", group="response_group")
    assert sessions.where("block = 'e' and bin = 2").first()["n_units"] == 1 and subjects.where("block = 'r' and bin = 2").first()["mean_rate"] == 12.0


def test_panels(spark):
    from trialstream.operators import panels as PN

    blocks = spark.createDataFrame([(s, b, float(v), n) for s, n in ((1, 2), (2, 2), (3, 1)) for b, v in zip(PN.BLOCKS, (4, 1, 2), strict=True)] + [(4, "no_reward", 1.0, 2)], "s int, b string, v double, n int")
    contrasts = spark.createDataFrame([(1, 2.0, 2), (2, 2.5, 2), (3, 2.0, 2)], "s int, c double, m int")
    got = {r["s"]: (r["is_connected"], r["reconstructed"], r["difference"]) for r in PN.connected_blocks(blocks, contrasts, subject="s", block="b", value="v", sessions="n", contrast="c", contrast_sessions="m").collect()}
    assert got == {1: (True, 2.0, 0.0), 2: (True, 2.0, 0.5), 3: (False, None, None), 4: (False, None, None)}
    panel = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 4.0)], "k string, bin int, mean double")
    grid = spark.createDataFrame([("a", 1), ("b", 1)], "k string, bin int")
    assert {r["mean"] for r in PN.complete_rows(panel, grid, keys=["k", "bin"]).collect()} == {2.0, 4.0}
    for bad in (panel.where("mean < 4"), panel.union(panel)):
        with pytest.raises(Exception, match="not one row for"):
            PN.complete_rows(bad, grid, keys=["k", "bin"]).collect()
    stated = spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 3), ("c", 3.0, 3), ("d", None, 0), ("e", 1.0, 1), ("f", 1e6 + 1e-4, 2)], "k string, estimate double, n_mice int")
    drawn = spark.createDataFrame([("a", 1.0, 3), ("b", 2.1, 3), ("c", 3.0, 4), ("d", None, 0), ("g", 1.0, 1), ("f", 1e6, 2)], "k string, mean double, n int")
    assert {tuple(r) for r in PN.panel_mismatches(stated, drawn, key="k").collect()} == {("b", "other_estimate"), ("c", "other_n"), ("e", "not_drawn"), ("g", "no_statistic")}
    with pytest.raises(ValueError, match="two different"):
        PN.pair_panel(blocks, source_region="x", target_region="x", subject="s", block="b", value="v")
    q = PN.timing_quartiles(spark.createDataFrame([("x", float(i)) for i in range(5)], "g string, v double"), by=["g"], values=["v"]).first()
    assert tuple(q) == ("x", 5, 1.0, 2.0, 3.0)
