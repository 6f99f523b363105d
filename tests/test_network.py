"""The network fit from sums of products against a direct fit of the matrices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialstream.operators import network as N

SCHEMA = "g int, id int, time double, reward_block string, source_values array<double>, base_values array<double>, target_values array<double>"


def planted(per_block=(30, 30, 30), units=8, seed=4):
    """Engaged blocks in which the target follows the source, and one without in which it doesn't."""
    rng = np.random.default_rng(seed)
    rows, t = [], 0.0
    for block, n in zip(N.BLOCKS, per_block, strict=True):
        for _ in range(n):
            source, history = rng.normal(size=units), rng.normal(scale=0.4, size=units)
            target = 0.25 * history + rng.normal(scale=0.08, size=units)
            if block != "no_reward":
                target = target + source * np.linspace(1, 0.3, units)
            rows.append((t, block, source, np.r_[t / 90, t % 2, history], target))
            t += 1
    return rows


def frame(spark, groups):
    rows = [(g, i, t, b, s.tolist(), x.tolist(), y.tolist()) for g, own in groups.items() for i, (t, b, s, x, y) in enumerate(own)]
    return spark.createDataFrame(rows, SCHEMA)


def ridge(x, y, alpha):
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def predictions(x, s, y, train, held, base_alpha, alpha=None, rank=None):
    """(observed, base prediction, full prediction) of held rows, in units of the training rows."""
    z = []
    for m in (x, s, y):
        scale = m[train].std(axis=0)
        z.append((m - m[train].mean(axis=0)) / np.where(scale > 1e-12, scale, 1))
    x, s, y = z
    base = ridge(x[train], y[train], base_alpha)
    out = x[held] @ base
    if alpha is None:
        return y[held], out, None
    known = ridge(x[train], s[train], base_alpha)
    left = s[train] - x[train] @ known
    c = ridge(left, y[train] - x[train] @ base, alpha)
    _, _, v = np.linalg.svd(left @ c, full_matrices=False)
    return y[held], out, out + (s[held] - x[held] @ known) @ c @ v[:rank].T @ v[:rank]


def direct(rows, config, least):
    """Figures of one block's rows, in order of time."""
    n = len(rows)
    rows = [rows[int((i + 0.5) * n / least)] for i in range(least)]
    s, x, y = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    shifted = np.roll(s, max(1, least // 2), axis=0)
    seen, base, full, shift, choices = [], [], [], [], []
    for held in np.array_split(np.arange(least), config.outer_folds):
        train = np.setdiff1d(np.arange(least), held)
        inner = np.array_split(train, config.inner_folds)

        def error(which, base_alpha, alpha=None, rank=None, train=train, inner=inner):
            parts = [predictions(x, s, y, np.setdiff1d(train, v), v, base_alpha, alpha, rank) for v in inner]
            return sum(((p[0] - p[which]) ** 2).sum() for p in parts)

        base_alpha = -min((error(1, a), -a) for a in config.alphas)[1]
        _, rank, alpha = min((error(2, base_alpha, a, r), r, -a) for a in config.alphas for r in config.ranks if r <= min(s.shape[1], y.shape[1]))
        choices.append((base_alpha, -alpha, rank))
        observed, plain, own = predictions(x, s, y, train, held, base_alpha, -alpha, rank)
        seen.append(observed)
        base.append(plain)
        full.append(own)
        shift.append(predictions(x, shifted, y, train, held, base_alpha, -alpha, rank)[2])
    r2 = lambda p: 1 - ((np.vstack(seen) - np.vstack(p)) ** 2).sum() / (np.vstack(seen) ** 2).sum()
    return r2(base), r2(full), r2(shift), choices


def test_equals_direct_fit_and_recovers(spark):
    config = N.NetworkConfig()
    groups = {1: planted(), 2: planted((26, 31, 28), seed=9), 3: planted((30, 5, 30)), 4: planted((20, 20, 0)), 5: planted(units=3)}
    got = {(r["g"], r["reward_block"]): r for r in N.network_by_block(frame(spark, groups).repartition(5), config, by=["g"]).collect()}
    assert len(got) == 15
    for g, least in ((1, 30), (2, 26)):
        for block in N.BLOCKS:
            r = got[g, block]
            base, full, shift, choices = direct([x for x in groups[g] if x[1] == block], config, least)
            assert r["status"] == "pass" and r["n_trials"] == least
            assert [(f["base_alpha"], f["source_alpha"], f["rank"]) for f in r["folds"]] == choices
            assert np.allclose([r["base_r2"], r["full_r2"], r["shift_full_r2"]], [base, full, shift], atol=1e-8)
            assert r["real_minus_shift_source_added_r2"] == pytest.approx(full - shift, abs=1e-8)
            assert sum(f["n_validation"] for f in r["folds"]) == least
            assert (r["source_added_r2"] > 0.5) == (block != "no_reward") and (r["real_minus_shift_source_added_r2"] > 0.4) == (block != "no_reward")
    assert {got[3, b]["status"] for b in N.BLOCKS} == {got[4, b]["status"] for b in N.BLOCKS} == {"too_few_trials"}
    assert {got[5, b]["status"] for b in N.BLOCKS} == {"too_few_units"} and got[5, "no_reward"]["full_r2"] is None


def test_missing_values(spark):
    df = frame(spark, {1: planted()})
    odd = df.withColumn("source_values", F.when(F.col("id") == 3, F.transform("source_values", lambda x: F.lit(None).cast("double"))).otherwise(F.col("source_values")))
    got = {r["reward_block"]: r["status"] for r in N.network_by_block(odd, by=["g"]).collect()}
    assert got == {"engaged_1": "uneven_values", "no_reward": "pass", "engaged_2": "pass"}
    assert N.network_by_block(df.limit(0), by=["g"]).collect() == []


def test_trial_covariates(spark):
    nan = float("nan")
    rows = [(1, 10.0, "b", True, 0.3), (1, 20.0, "a", None, nan), (1, 40.0, None, False, None), (1, 30.0, "c", True, 0.5), (2, 5.0, None, None, None)]
    df = spark.createDataFrame(rows, "g int, change_time double, image string, response boolean, latency double")
    got = {(r["g"], r["change_time"]): r["nuisance"] for r in N.trial_covariates(df, by=["g"], latency="latency").collect()}
    slow = lambda t: (t - 25) / 15
    want = {(1, 10.0): [slow(10), slow(10) ** 2, 1, 0, 1, 0.3, 0], (1, 20.0): [slow(20), slow(20) ** 2, 0, 0, 0, 0.4, 1], (1, 40.0): [1, 1, 0, 0, 0, 0.4, 1], (1, 30.0): [slow(30), slow(30) ** 2, 0, 1, 1, 0.5, 0], (2, 5.0): [0, 0, 0, 0, 1]}
    assert set(got) == set(want) and all(np.allclose(got[k], v) for k, v in want.items())


def test_blocks_are_solved_together_where_their_trials_are(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 4, 4, 40, 12))
    x[..., 0] = 1
    sums = np.swapaxes(x, -1, -2) @ x
    alone = [N.fit_blocks(sums[i : i + 1], (3, 2, 4), N.NetworkConfig())[0] for i in range(5)]
    for one, own in zip(alone, N.fit_blocks(sums, (3, 2, 4), N.NetworkConfig()), strict=True):
        for a, b in zip(one, own, strict=True):
            assert a == pytest.approx(b)
    rows = frame(spark, {g: planted((14, 13, 15), seed=g) for g in range(12)})
    out = N.network_by_block(rows.repartition(3, "g"), by=["g"])
    assert {(r["status"], r["n_trials"]) for r in out.collect()} == {("pass", 13)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange ") == 1 and "FlatMapGroupsIn" not in final


def test_constant_columns_stay_unscaled():
    x = np.column_stack([np.ones(13), np.full(13, 0.7), np.full(13, np.sqrt(3) - 1), np.arange(13.0)])
    m = N.Moments(x.T @ x, 1, 1)
    assert np.allclose(np.diag(m.turn[:, 1:])[:2], 1) and np.allclose(m.gram[:2], 0, atol=1e-12) and m.gram[2, 2] == pytest.approx(13)
