"""Models by group. Features, folds, sums of products and scores are DataFrame operations; a task only solves small systems."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Fixed values of the search.
LAMBDAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)


def model_design(trials: DataFrame, *, source: str = "source", time: str = "time", block: str = "reward_block", image: str | None = "image", images: list[str] | None = None, response: str | None = None, latency: str | None = None, default_latency: float = 0.45) -> DataFrame:
    """trials with columns x0, x1, ...: reversible, drift, standardised time, its square, an indicator per image but the first, response and latency (null filled with the session's median)."""
    from pyspark.sql.window import Window

    own = Window.partitionBy(source)
    z = (F.col(time) - F.avg(time).over(own)) / F.coalesce(F.nullif(F.stddev_pop(time).over(own), F.lit(0.0)), F.lit(1.0))
    state = F.when(F.col(block) == "no_reward", -1.0).otherwise(0.5)
    drift = F.when(F.col(block) == "engaged_1", -1.0).when(F.col(block) == "engaged_2", 1.0).otherwise(0.0)
    columns = [state, drift, z, z * z, *[(F.col(image) == i).cast("double") for i in (images or [])[1:]]]
    if response:
        columns.append(F.col(response).cast("double"))
    if latency:
        columns.append(F.coalesce(F.col(latency), F.median(latency).over(own), F.lit(default_latency)))
    return trials.withColumns({f"x{i}": c for i, c in enumerate(columns)})


def moments(rows: DataFrame, xs: list[str], y: str, *, by: list[str]) -> DataFrame:
    """(by, n, xx, xy, yy): sums of products with a leading 1, as flat arrays, in one aggregate with partial sums."""
    one = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    xx = [F.sum(a * b) for i, a in enumerate(one) for b in one[i:]]
    return rows.where(F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*[F.sum(a * F.col(y)) for a in one]).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))


def _square(flat, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = flat
    return out + np.triu(out, 1).T


def _ridge_from_moments(m: np.ndarray, v: np.ndarray, lam: float) -> np.ndarray:
    """Coefficients, intercept first, of a ridge on standardised columns."""
    n = m[0, 0]
    mean, my = m[0, 1:] / n, v[0] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-9] = 1
    c = (v[1:] / n - mean * my) / scale
    beta = np.linalg.solve(cov / np.outer(scale, scale) + lam / n * np.eye(len(scale)), c) / scale
    return np.concatenate([[my - mean @ beta], beta])


def _sse(m: np.ndarray, v: np.ndarray, yy: float, b: np.ndarray) -> float:
    return float(yy - 2 * b @ v + b @ m @ b)


def nested_ridge(fold_moments: DataFrame, *, by: list[str], folds: int, lambdas: tuple[float, ...] = LAMBDAS, fold: str = "fold") -> DataFrame:
    """(by, r2, lam, coefficients): out-of-fold R2 of a ridge whose lambda is chosen within each training part, and the refit on all rows.

    fold_moments: moments by (by, fold); a group is as many small rows as there are folds. Ties take the larger lambda.
    """
    ship(fold_moments.sparkSession)
    order = sorted(lambdas, reverse=True)

    def best(parts: list[tuple]) -> float:
        total = [sum(p[i] for p in parts) for i in range(3)]
        errors = [sum(_sse(*p, _ridge_from_moments(total[0] - p[0], total[1] - p[1], lam)) for p in parts) for lam in order]
        return order[int(np.argmin(np.round(errors, 9)))]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(fold)
        p = len(rows["xy"].iloc[0])
        parts = [(_square(r.xx, p), np.array(r.xy), r.yy) for r in rows.itertuples()]
        key = [rows[c].iloc[0] for c in by]
        if len(parts) < folds or min(q[0][0, 0] for q in parts) < 2:
            return pd.DataFrame([(*key, None, None, None)], columns=[*by, "r2", "lam", "coefficients"])
        error = 0.0
        for k, part in enumerate(parts):
            rest = parts[:k] + parts[k + 1 :]
            lam = best(rest)
            error += _sse(*part, _ridge_from_moments(sum(q[0] for q in rest), sum(q[1] for q in rest), lam))
        m, v, yy = (sum(q[i] for q in parts) for i in range(3))
        spread = yy - v[0] ** 2 / m[0, 0]
        lam = best(parts)
        return pd.DataFrame([(*key, 1 - error / spread if spread > 1e-12 else None, lam, _ridge_from_moments(m, v, lam).tolist())], columns=[*by, "r2", "lam", "coefficients"])

    kinds = ", ".join(f"{c} {fold_moments.schema[c].dataType.simpleString()}" for c in by)
    return fold_moments.groupBy(*by).applyInPandas(fit, f"{kinds}, r2 double, lam double, coefficients array<double>")
