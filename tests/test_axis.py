"""The axis from sums over units against a direct fit of the matrix of trials by units."""

from __future__ import annotations

import numpy as np
import pytest

from trialstream.operators import axis as A

SCHEMA = "source int, event bigint, time double, reward_block string, unit string, value double"


def session(seed=2, sizes=(13, 17, 8), units=40, shift=0.0):
    rng = np.random.default_rng(seed)
    blocks = np.repeat(["engaged_1", "no_reward", "engaged_2"], sizes)
    x = rng.normal(0, 0.7, (len(blocks), units)) + np.linspace(0, 1, len(blocks))[:, None] * rng.normal(size=units)
    x[:, : units // 4] += np.where(blocks == "engaged_1", 1.0, np.where(blocks == "no_reward", -1.0, 0.5 + shift))[:, None]
    x[:, -1] = 3.0
    return x, blocks


def rows_of(source, x, blocks, times=None):
    times = range(len(x)) if times is None else times
    return [(source, i, float(t), str(b), f"u{u}", float(v)) for i, (t, b, row) in enumerate(zip(times, blocks, x, strict=True)) for u, v in enumerate(row)]


def fit(x, y, ridge):
    """Raw weights and intercept, by the primal system."""
    w = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    mean = w @ x
    scale = np.sqrt(w @ (x - mean) ** 2)
    scale[scale <= 1e-12] = 1
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ (z * w[:, None]) + ridge * np.eye(z.shape[1]), z.T @ (w * y))
    s = z @ beta
    high, low = s[y > 0].mean(), s[y < 0].mean()
    raw = beta / scale / (high - low)
    return raw, -(mean @ raw) - (high + low) / 2 / (high - low)


def direct(x, blocks, config):
    y = np.where(blocks == "engaged_1", 1.0, np.where(blocks == "no_reward", -1.0, 0.0))
    whole = np.flatnonzero(y)

    def folds(rows, n):
        return [np.concatenate(p) for p in zip(*(np.array_split(rows[y[rows] == s], n) for s in (1, -1)), strict=True)]

    def best(rows):
        losses = []
        for ridge in config.ridges:
            e = []
            for held in folds(rows, config.inner_folds):
                train = np.setdiff1d(rows, held)
                w, c = fit(x[train], y[train], ridge)
                d = (x[held] @ w + c - y[held] / 2) ** 2
                e.append(d[y[held] > 0].mean() / 2 + d[y[held] < 0].mean() / 2)
            losses.append(np.mean(e))
        return config.ridges[int(np.argmin(losses))]

    scores = np.zeros(len(y))
    for held in folds(whole, config.outer_folds):
        train = np.setdiff1d(whole, held)
        w, c = fit(x[train], y[train], best(train))
        scores[held] = x[held] @ w + c
    ridge = best(whole)
    w, c = fit(x[whole], y[whole], ridge)
    scores[y == 0] = x[y == 0] @ w + c
    pairs = scores[y > 0][:, None] - scores[y < 0]
    return scores, w, c, ridge, ((pairs > 0) + (pairs == 0) / 2).mean()


def test_equals_direct_fit(spark):
    sessions = {1: session(), 2: session(5, (25, 20, 0), 7), 3: session(7, (5, 30, 3), 4)}
    rows = [r for s, (x, b) in sessions.items() for r in rows_of(s, x, b)]
    rows += rows_of(4, *session(9))[1:] + rows_of(5, np.ones((30, 3)), session(sizes=(15, 15, 0))[1]) + [(1, 99, 99.0, "transition", "u0", 1.0)]
    config = A.AxisConfig(unit_block=6)
    got = A.state_axis(spark.createDataFrame(rows, SCHEMA).repartition(6), config).collect()
    of = lambda s, kind, key: {r[key]: r["value"] for r in got if r["source"] == s and r["kind"] == kind}
    for s in (1, 2):
        x, blocks = sessions[s]
        scores, w, c, ridge, auc = direct(x, blocks, config)
        own = of(s, "score", "event")
        assert np.allclose([own[i] for i in range(len(x))], scores, atol=1e-8)
        weights = of(s, "weight", "unit")
        assert np.allclose([weights[f"u{u}"] for u in range(x.shape[1])], w, atol=1e-8)
        assert of(s, "intercept", "unit")[None] == pytest.approx(c, abs=1e-7) and of(s, "ridge", "unit")[None] == ridge and of(s, "auc", "unit")[None] == pytest.approx(auc)
        assert np.mean([own[i] for i in np.flatnonzero(blocks == "engaged_1")]) > np.mean([own[i] for i in np.flatnonzero(blocks == "no_reward")])
    assert sorted((r["source"], r["kind"], r["value"]) for r in got if r["source"] > 2) == [(3, "too_few_trials", None), (4, "missing_values", None), (5, "degenerate", None)]


def test_transfer_block_cannot_leak(spark):
    a, b = (A.state_axis(spark.createDataFrame(rows_of(1, *session(shift=s)), SCHEMA)).collect() for s in (0.0, 1000.0))
    part = lambda rows, kinds, after=99: sorted((r["kind"], r["event"] or 0, r["unit"] or "", round(r["value"], 9)) for r in rows if r["kind"] in kinds and (r["event"] or 0) < after)
    assert part(a, ("weight", "intercept", "ridge", "auc")) == part(b, ("weight", "intercept", "ridge", "auc"))
    assert part(a, ("score",), 30) == part(b, ("score",), 30) and part(a, ("score",)) != part(b, ("score",))


def test_times_order_the_folds(spark):
    x, blocks = session()
    order = np.random.default_rng(1).permutation(len(x))
    rows = [(1, 100 - i, float(t), str(b), f"u{u}", float(v)) for i, (t, b, row) in enumerate(zip(order, blocks[order], x[order], strict=True)) for u, v in enumerate(row)]
    got = {r["event"]: r["value"] for r in A.state_axis(spark.createDataFrame(rows, SCHEMA)).where("kind = 'score'").collect()}
    scores = direct(x, blocks, A.AxisConfig())[0]
    assert np.allclose([got[100 - i] for i in range(len(x))], scores[order], atol=1e-8)
    assert A.state_axis(spark.createDataFrame([], SCHEMA)).collect() == []


def test_frozen_axis(spark):
    features = spark.createDataFrame([(1, 1, "a", 2.0), (1, 1, "b", 3.0), (1, 2, "a", 5.0), (2, 1, "a", 1.0), (1, 2, "unknown", 9.0)], "source int, event int, unit string, value double")
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "b", -1.0), (2, "a", 1.0)], "source int, unit string, value double")
    intercepts = spark.createDataFrame([(1, 10.0)], "source int, value double")
    assert {tuple(r) for r in A.axis_scores(features, weights, intercepts).collect()} == {(1, 1, 8.0), (1, 2, 12.5)}


def test_fits_where_units_are(spark):
    """Sessions of few units, of more units than trials and of batches that part them: one fit each, and no matrix leaves a task."""
    rows = [r for s in range(30) for r in rows_of(s, *session(s, (8, 9, 4), 3 if s % 2 else 30))]
    for parts in (None, 7):
        out = A.state_axis(spark.createDataFrame(rows, SCHEMA).repartition(9), parts=parts)
        got = out.collect()
        assert sorted(r["source"] for r in got if r["kind"] in ("auc", "degenerate")) == list(range(30))
        fitted = {r["source"] for r in got if r["kind"] == "auc"}
        assert len(fitted) > 20 and sorted((r["source"], r["unit"]) for r in got if r["kind"] == "weight") == sorted((s, f"u{u}") for s in fitted for u in range(3 if s % 2 else 30))
        assert "FlatMapGroupsIn" not in out._jdf.queryExecution().executedPlan().toString()
    x, blocks = session()
    y = np.where(blocks == "engaged_1", 1.0, np.where(blocks == "no_reward", -1.0, 0.0))
    few, many = A.Session(y, A.AxisConfig()), A.Session(y, A.AxisConfig())
    few.add(x.T[:20])
    many.add(np.vstack([x.T[:20], np.ones((40, len(y)))]))
    assert few.sums is None and many.values is None
    for a, b in zip(few.fit(), many.fit(), strict=True):
        assert np.allclose(a, b, atol=1e-8)


def test_equal_trials_tie():
    rng = np.random.default_rng(8)
    y = np.repeat([1.0, -1.0], 20)
    for _ in range(20):
        s = A.Session(y, A.AxisConfig())
        s.add(np.sqrt(rng.integers(0, 2, (3, 40)) + 0.3) + 0.01 * y)
        scores, *_, auc = s.fit()
        d = scores[y > 0][:, None] - scores[y < 0]
        assert auc == pytest.approx(((d > 1e-8) + (abs(d) <= 1e-8) / 2).mean(), abs=1e-12)
