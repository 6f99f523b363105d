"""A session's reward-state axis: class-balanced ridge, by products of trials where units are many and of units where trials are.

For every training part of the nested cross-validation a unit's values are standardised by that part alone. A task meets a session's units one
after another and keeps their values while they are fewer than its trials, else sums of their contributions to each part's trial-by-trial matrix, so
it solves systems as large as the smaller number; weights of units follow from the solution unit by unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..shipping import ship

#: Fixed values of the search.
RIDGES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
#: A unit whose deviation is under this share of its mean (or of 1) doesn't vary; rounding alone gives a little.
CONSTANT = 1e-12
POSITIVE, NEGATIVE, TRANSFER = "engaged_1", "no_reward", "engaged_2"


@dataclass(frozen=True)
class AxisConfig:
    outer_folds: int = 5
    inner_folds: int = 3
    ridges: tuple[float, ...] = RIDGES
    min_trials: int = 6
    #: Units of one session that are standardised at a time.
    unit_block: int = 256


def balance(y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weights of all trials that give both classes of rows a half; 0 elsewhere."""
    w = np.zeros(len(y))
    for sign in (1, -1):
        own = rows[y[rows] == sign]
        w[own] = 0.5 / len(own)
    return w


def folds_of(y: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """rows, which are in time order, in n contiguous folds of each class; never more than a class has rows."""
    classes = [rows[y[rows] == sign] for sign in (1, -1)]
    n = min(n, *map(len, classes))
    return [np.sort(np.concatenate(parts)) for parts in zip(*(np.array_split(c, n) for c in classes), strict=True)]


def training_parts(y: np.ndarray, config: AxisConfig) -> dict[tuple[int, int], np.ndarray]:
    """Rows of the training parts: (k, -1) without outer fold k, (k, j) of that without its inner fold j; k = -1 for all rows."""

    def without(rows: np.ndarray, held: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(y), bool)
        kept[rows] = True
        kept[held] = False
        return np.flatnonzero(kept)

    whole = np.flatnonzero(y)
    outer = {-1: whole} | {k: without(whole, held) for k, held in enumerate(folds_of(y, whole, config.outer_folds))}
    out = {}
    for k, rows in outer.items():
        out[k, -1] = rows
        out |= {(k, j): without(rows, held) for j, held in enumerate(folds_of(y, rows, config.inner_folds))}
    return out


class Degenerate(Exception):
    pass


def standardised(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(parts, units, trials): x (units, trials) in units of each part, given the parts' weights (parts, trials)."""
    mean = weights @ x.T
    z = x - mean[..., None]
    scale = np.sqrt((z**2 @ weights[..., None])[..., 0])
    return z / np.where(scale <= CONSTANT * np.maximum(1, np.abs(mean)), 1, scale)[..., None]


class Session:
    """A session's units by training part, while they pass: as values while units are fewer than trials, else as the parts' trial-by-trial matrices.

    Either gives the same fit: with values, its systems are as large as the number of units, with matrices as that of trials.
    """

    def __init__(self, y: np.ndarray, config: AxisConfig):
        self.y, self.config = y, config
        self.parts = training_parts(y, config)
        self.place = {key: i for i, key in enumerate(self.parts)}
        self.weights = np.array([balance(y, rows) for rows in self.parts.values()])
        self.values: np.ndarray | None = np.zeros((0, len(y)))
        self.sums: np.ndarray | None = None

    def add(self, x: np.ndarray) -> None:
        """x: values by unit and trial."""
        if self.values is not None:
            self.values = x = np.vstack([self.values, x])
            if len(x) < len(self.y):
                return
            self.values, self.sums = None, np.zeros((len(self.parts), len(self.y), len(self.y)))
        for i in range(0, len(x), self.config.unit_block):
            block = x[i : i + self.config.unit_block]
            for total, w in zip(self.sums, self.weights, strict=True):
                z = standardised(block, w[None])[0]
                total += z.T @ z

    def projections(self, at: list[int], ridges: np.ndarray) -> np.ndarray:
        """(parts, ridges, trials): what the fits of the parts at give all trials, classes not yet at a half. ridges: the same for all parts, or a row for each."""
        w = self.weights[at]
        root = np.sqrt(w)
        target = (np.sign(self.y) * root)[:, :, None]
        eye = np.broadcast_to(ridges, (len(at), ridges.shape[-1]))[..., None, None]
        if self.values is not None:
            z = standardised(self.values, w)
            own = z * root[:, None]
            beta = np.linalg.solve((own @ np.swapaxes(own, 1, 2))[:, None] + eye * np.eye(len(self.values)), (own @ target)[:, None])
            return (np.swapaxes(z, 1, 2)[:, None] @ beta)[..., 0]
        out = []
        for kernel, r, t, e in zip(self.sums[at], root, target, eye, strict=True):
            c = np.linalg.solve(kernel * np.outer(r, r) + e * np.eye(len(r)), np.broadcast_to(t, (len(e), *t.shape)))
            out.append((kernel @ (r[:, None] * c))[..., 0])
        return np.array(out)

    def lines(self, at: list[int], ridges: np.ndarray) -> np.ndarray:
        """projections with the means of the classes of each part at a half and minus a half."""
        raw = self.projections(at, ridges)
        w = self.weights[at][:, None]
        high, low = (2 * (raw * (w * (self.y == s))).sum(-1, keepdims=True) for s in (1, -1))
        if not (high - low > np.finfo(float).eps * np.maximum(1.0, np.maximum(np.abs(high), np.abs(low))) * 32).all():
            raise Degenerate
        return (raw - (high + low) / 2) / (high - low)

    def choices(self) -> dict[int, float]:
        """The ridge with the least class-balanced error over the inner folds of each outer part; the smaller one if equal."""
        inner = [key for key in self.parts if key[1] >= 0]
        held = np.array([(self.weights[self.place[k, -1]] > 0) & (self.weights[self.place[k, j]] == 0) for k, j in inner])
        off = (self.lines([self.place[key] for key in inner], np.array(self.config.ridges)) - self.y / 2) ** 2
        classes = [held & (self.y == s) for s in (1, -1)]
        error = sum((off * c[:, None]).sum(-1) / c.sum(-1)[:, None] for c in classes) / 2
        outer = np.array([k for k, _ in inner])
        return {int(k): self.config.ridges[int(np.argmin(error[outer == k].mean(0)))] for k in np.unique(outer)}

    def fit(self) -> tuple:
        """(scores, coefficients, constant, ridge, ridges of the outer folds, AUC)."""
        y, chosen = self.y, self.choices()
        scores, folds = np.zeros(len(y)), [k for k in chosen if k >= 0]
        outer = [self.place[k, -1] for k in folds]
        for line, w in zip(self.lines(outer, np.array([[chosen[k]] for k in folds]))[:, 0], self.weights[outer], strict=True):
            held = (y != 0) & (w == 0)
            scores[held] = line[held]
        own = self.place[-1, -1]
        if self.values is None:
            kernel = self.sums[own]
        else:
            z = standardised(self.values, self.weights[[own]])[0]
            kernel = z.T @ z
        c, constant = dual_axis(kernel, y, self.weights[own], chosen[-1])
        scores[y == 0] = kernel[y == 0] @ c + constant
        near = np.round(scores, 9)  # equal trials tie, whatever rounding adds
        high, low = near[y > 0], np.sort(near[y < 0])
        wins = np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")
        return scores, c, constant, chosen[-1], [chosen[k] for k in folds], wins.sum() / 2 / len(high) / len(low)


def dual_axis(kernel: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Coefficients of trials and a constant, so that kernel @ coefficients + constant has the classes' means at a half and minus a half."""
    root = np.sqrt(w)
    rows = np.flatnonzero(w)
    system = kernel[np.ix_(rows, rows)] * np.outer(root[rows], root[rows])
    c = np.zeros(len(w))
    c[rows] = root[rows] * np.linalg.solve(system + ridge * np.eye(len(rows)), y[rows] * root[rows])
    raw = kernel @ c
    high, low = raw[(w > 0) & (y > 0)].mean(), raw[(w > 0) & (y < 0)].mean()
    if not high - low > np.finfo(float).eps * max(1.0, abs(high), abs(low)) * 32:
        raise Degenerate
    return c / (high - low), -(high + low) / 2 / (high - low)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def state_axis(features: DataFrame, config: AxisConfig = AxisConfig(), *, source: str = "source", event: str = "event", time: str = "time", block: str = "reward_block", unit: str = "unit", value: str = "value", parts: int | None = None) -> DataFrame:
    """Long rows (source, kind, event, unit, value) of the axis that tells the block engaged_1 from no_reward in each session.

    features: one row for each session, event and unit. kind: score (out of fold in the two blocks; in engaged_2, which no part of the fit sees,
    by the final axis), weight and intercept (in units of the values), ridge, auc (of out-of-fold scores). Means of the classes are at +-0.5.
    A session without figures has one row whose kind says why: too_few_trials (min_trials in both blocks), missing_values (a unit without
    a finite value in some event, or with several), degenerate (the values don't tell the blocks apart). Other blocks are left out.
    parts: partitions that sessions are dealt to, as their fits take far longer than their few bytes suggest; by default Spark's own number.
    """
    ship(features.sparkSession)
    kind = features.schema[source].dataType.simpleString()
    rows = features.where(F.col(block).isin(POSITIVE, NEGATIVE, TRANSFER)).select(source, event, F.col(time).cast("double").alias("_t"), F.col(block).alias("_b"), unit, F.col(value).cast("double").alias("_v"))
    events = rows.select(source, event, "_t", "_b").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(source).orderBy("_t", event)) - 1)
    sign = F.when(F.col("_b") == POSITIVE, 1.0).when(F.col("_b") == NEGATIVE, -1.0).otherwise(0.0)
    sessions = events.groupBy(source).agg(F.sort_array(F.collect_list(F.struct("_i", sign.alias("y"), F.col(event).alias("event")))).alias("_e")).select(source, F.col("_e.y").alias("y"), F.col("_e.event").alias("events"))
    cells = rows.join(events, [source, event, "_t", "_b"])
    vectors = cells.groupBy(source, unit).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_x")).join(sessions, source)
    finite = F.forall("_x", lambda x: x["_v"].isNotNull() & ~F.isnan(x["_v"]) & (F.abs(x["_v"]) < float("inf")))
    distinct = F.size(F.array_distinct(F.col("_x._i"))) == F.size("_x")
    vectors = vectors.select(source, unit, F.col("_x._v").alias("x"), "y", "events", ((F.size("_x") == F.size("y")) & distinct & finite).alias("whole"))
    n_of = lambda s: F.size(F.filter("y", lambda v: v == s))
    refused = F.when(F.least(n_of(1.0), n_of(-1.0)) < config.min_trials, "too_few_trials").when(~F.col("whole"), "missing_values")
    # the window leaves a session's units in one partition, whatever joins become before it
    dealt = vectors.repartition(parts, source) if parts else vectors
    fitted = dealt.select(source, "x", "y", F.min("whole").over(Window.partitionBy(source)).alias("whole")).where(refused.isNull())
    result = f"{source} {kind}, why string, scores array<double>, c array<double>, w array<double>, constant double, ridge double, outer_ridges array<double>, auc double"
    schema = to_arrow_schema(StructType.fromDDL(result))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fit of each session, once its units have passed."""
        name: tuple | None = None
        session: Session | None = None
        done: list[tuple] = []

        def close() -> None:
            try:
                scores, c, *rest = session.fit()
                done.append((*name, "pass", scores, c, session.weights[session.place[-1, -1]], *rest))
            except Degenerate:
                done.append((*name, "degenerate", *[None] * 7))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return batch

        for batch in batches:
            ends, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            keys = pc.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()] if batch.num_rows else []
            for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                own = (batch.column(0)[a].as_py(),)
                if own != name:
                    if name is not None:
                        close()
                    if len(done) >= 500:
                        yield out()
                    name, session = own, Session(batch.column(2)[a].values.to_numpy(zero_copy_only=False).astype(float), config)
                session.add(values[ends[a] : ends[z]].reshape(z - a, -1))
        if name is not None:
            close()
            yield out()

    solved = fitted.select(source, "x", "y").sortWithinPartitions(source).mapInArrow(run, result)
    # the fit is consumed once: a session's weights come back as one row beside its scores
    dual = vectors.join(solved, source, "left").withColumn("mean", _dot(F.col("x"), F.col("w")))
    spread = F.aggregate(F.zip_with("x", "w", lambda a, b: (a - F.col("mean")) * (a - F.col("mean")) * b), F.lit(0.0), lambda s, a: s + a)
    scale = F.when(F.sqrt(spread) <= CONSTANT * F.greatest(F.lit(1.0), F.abs("mean")), 1.0).otherwise(spread)
    along = F.aggregate(F.zip_with("x", "c", lambda a, b: (a - F.col("mean")) * b), F.lit(0.0), lambda s, a: s + a)
    dual = dual.withColumn("value", along / scale)
    fits = dual.groupBy(source).agg(F.collect_list(F.struct(F.col(unit).alias("u"), "value")).alias("weights"), F.sum(F.col("mean") * F.col("value")).alias("moved"), *[F.first(c).alias(c) for c in ("scores", "constant", "ridge", "auc", "y", "events")], F.first("why").alias("fitted"), F.min("whole").alias("whole"))
    every = fits.withColumn("why", F.coalesce(refused, F.nullif("fitted", F.lit("pass"))))
    events_type, unit_type = (features.schema[c].dataType.simpleString() for c in (event, unit))

    def row(kind: str | Column, value: Column | None, of_event: Column | None = None, of_unit: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(F.lit(kind).alias("kind"), (none if of_event is None else of_event).cast(events_type).alias("event"), (none if of_unit is None else of_unit).cast(unit_type).alias("unit"), (none if value is None else value).cast("double").alias("value"))

    single = F.array(row("intercept", F.col("constant") - F.col("moved")), row("ridge", F.col("ridge")), row("auc", F.col("auc")))
    scored = F.zip_with("events", "scores", lambda e, s: row("score", s, e))
    weighted = F.transform("weights", lambda w: row("weight", w["value"], None, w["u"]))
    rows_of = F.when(F.col("why").isNotNull(), F.array(row(F.col("why"), None))).otherwise(F.concat(scored, weighted, single))
    return every.select(source, F.explode(rows_of).alias("r")).select(source, "r.kind", F.col("r.event").alias(event), F.col("r.unit").alias(unit), "r.value")


def axis_scores(features: DataFrame, weights: DataFrame, intercepts: DataFrame, *, source: str = "source", event: str = "event", unit: str = "unit", value: str = "value") -> DataFrame:
    """(source, event, score): intercept plus the sum of weight times value over the units of a frozen axis. A unit without a weight counts nothing; a session without an intercept has no rows."""
    dot = features.join(weights.select(source, unit, F.col("value").alias("_w")), [source, unit]).groupBy(source, event).agg(F.sum(F.col(value) * F.col("_w")).alias("_s"))
    return dot.join(intercepts.select(source, F.col("value").alias("_c")), source).select(source, event, (F.col("_s") + F.col("_c")).alias("score"))
