"""What a source region's units add to the prediction of a target region's, by session, pair and block.

Trials are balanced over blocks and dealt into contiguous folds by windows. All that the fits need are sums of products of
the columns by fold, which a task adds up while the trials of its sessions pass, in matrices of bounded size; standardising, partialling out,
ridge, rank reduction and errors follow from them, for many blocks at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..shipping import ship
from .blocks import spaced_place

#: The search space and the blocks of the fit.
ALPHAS = (0.1, 1.0, 10.0, 100.0)
RANKS = (1, 2, 4, 8)
BLOCKS = ("engaged_1", "no_reward", "engaged_2")
#: A column whose variance is under this share of its mean square doesn't vary; rounding of the sums alone gives a little.
CONSTANT = 1e-13


@dataclass(frozen=True)
class NetworkConfig:
    outer_folds: int = 4
    inner_folds: int = 3
    alphas: tuple[float, ...] = ALPHAS
    ranks: tuple[int, ...] = RANKS
    min_trials: int = 12
    min_units: int = 8


def trial_covariates(trials: DataFrame, *, by: list[str], time: str = "change_time", image: str = "image", response: str = "response", latency: str | None = None, name: str = "nuisance") -> DataFrame:
    """trials with name, an array of covariates of the trial within its session (by).

    In order: time from the middle of the session in half ranges (at least 1 s), its square, an indicator for each image of the
    session but the first by name, the response (null counts as none), and, if latency is given, the latency (where it is null or not
    finite, the session's median, or 0 without any) and an indicator of that.
    """
    own = Window.partitionBy(*by)
    low, high = F.min(time).over(own), F.max(time).over(own)
    slow = (F.col(time) - (low + high) / 2) / F.greatest((high - low) / 2, F.lit(1.0))
    others = F.slice(F.array_sort(F.collect_set(image).over(own)), 2, 1 << 30)
    parts = [F.array(slow, slow * slow), F.transform(others, lambda i: F.coalesce((F.col(image) == i).cast("double"), F.lit(0.0))), F.array(F.coalesce(F.col(response).cast("double"), F.lit(0.0)))]
    if latency:
        known = F.when(~F.isnan(latency) & (F.abs(F.col(latency)) < float("inf")), F.col(latency).cast("double"))
        parts.append(F.array(F.coalesce(known, F.median(known).over(own), F.lit(0.0)), known.isNull().cast("double")))
    return trials.withColumn(name, F.concat(*parts))


def _fold(at, n, folds: int):
    """The contiguous fold of the row at (from 0) of n, the larger folds first."""
    size, more = F.floor(n / folds), n % folds
    early = more * (size + 1)
    return F.when(at < early, F.floor(at / (size + 1))).otherwise(more + F.floor((at - early) / F.greatest(size, F.lit(1)))).cast("int")


def folded_trials(rows: DataFrame, config: NetworkConfig = NetworkConfig(), *, by: list[str], block: str = "reward_block", time: str = "time", key: str = "id", source: str = "source_values") -> DataFrame:
    """Balanced trials with their fold, their inner fold in the training part of each outer fold (-1 in that fold itself), and shifted_<source>: the source's values of the trial half the block away.

    One exchange by by is enough: what follows are windows within it and a grouping that names it, so a value of by stays in one partition.
    """
    own = Window.partitionBy(*by, block)
    kept = rows.where(F.col(block).isin(*BLOCKS))
    placed = kept.withColumn("_size", F.count("*").over(own)).withColumns({"_n": F.min("_size").over(Window.partitionBy(*by)), "_row": F.row_number().over(own.orderBy(time, key)) - 1})
    placed = placed.withColumn("_at", spaced_place("_row", "_size", "_n")).where(F.col("_at").isNotNull()).drop("_row", "_size")
    # each trial goes to its own place and its source to the place half the block away
    away = (F.col("_at") + F.greatest(F.lit(1), F.floor(F.col("_n") / 2))) % F.col("_n")
    dealt = placed.withColumn("_all", F.struct(*placed.columns)).select(*by, block, "_all", F.posexplode(F.array("_at", away)).alias("_moved", "_to"))
    first = lambda moved, value: F.first(F.when(F.col("_moved") == moved, F.struct(value.alias("v"))), ignorenulls=True)["v"]
    met = dealt.groupBy(*by, block, "_to").agg(first(0, F.col("_all")).alias("_all"), first(1, F.col("_all")[source]).alias(f"shifted_{source}"))
    placed = met.select("_all.*", f"shifted_{source}").withColumn("fold", _fold(F.col("_at"), F.col("_n"), config.outer_folds))
    inner = []
    size, more = F.floor(F.col("_n") / config.outer_folds), F.col("_n") % config.outer_folds
    for k in range(config.outer_folds):
        held = size + F.when(more > k, 1).otherwise(0)
        place = F.when(F.col("fold") > k, F.col("_at") - held).otherwise(F.col("_at"))
        inner.append(F.when(F.col("fold") == k, -1).otherwise(_fold(place, F.col("_n") - held, config.inner_folds)))
    return placed.withColumn("inner", F.array(*inner)).drop("_at", "_n")


def _turned(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


class Moments:
    """Sums of products of the base, source and target columns in units of a training part; of many parts at once, along leading axes."""

    def __init__(self, train: np.ndarray, nb: int, ns: int):
        n = train[..., :1, 0]
        mean = train[..., 0, 1:] / n
        square = np.diagonal(train, axis1=-2, axis2=-1)[..., 1:] / n
        scale = np.sqrt(np.maximum(square - mean**2, 0))
        scale[(scale <= 1e-12) | (scale**2 <= CONSTANT * square)] = 1
        self.turn = np.concatenate([(-mean / scale)[..., None], np.eye(scale.shape[-1]) / scale[..., None]], -1)
        self.b, self.s, self.t = slice(0, nb), slice(nb, nb + ns), slice(nb + ns, None)
        self.bs = slice(0, nb + ns)
        self.gram = self.standard(train)

    def standard(self, gram: np.ndarray) -> np.ndarray:
        return self.turn @ gram @ _turned(self.turn)

    def base(self, alpha: float | np.ndarray) -> np.ndarray:
        """Coefficients of the base columns for target and source. alpha: one number, or one for each part."""
        g = self.gram[..., self.b, self.b]
        return np.linalg.solve(g + np.asarray(alpha)[..., None, None] * np.eye(g.shape[-1]), self.gram[..., self.b, :])

    def added(self, base: np.ndarray, alpha: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the source's residuals for the target's, and the directions of the target, the strongest first."""
        w, v = base[..., self.t], base[..., self.s]
        g = self.gram
        left = np.concatenate([-v, np.broadcast_to(np.eye(v.shape[-1]), (*v.shape[:-2], v.shape[-1], v.shape[-1]))], -2)  # residuals of the source are [base source] @ left
        right = g[..., self.bs, self.t] - g[..., self.bs, self.b] @ w
        ss, st = _turned(left) @ g[..., self.bs, self.bs] @ left, _turned(left) @ right
        c = np.linalg.solve(ss + np.asarray(alpha)[..., None, None] * np.eye(ss.shape[-1]), st)
        return c, np.linalg.eigh(_turned(c) @ ss @ c)[1][..., ::-1]

    def full(self, base: np.ndarray, c: np.ndarray, directions: np.ndarray, rank: int | np.ndarray) -> np.ndarray:
        """Coefficients of base and source columns with the source's part at reduced rank. rank: one number, or one for each part."""
        keep = directions * (np.arange(directions.shape[-1]) < np.asarray(rank)[..., None])[..., None, :]
        r = c @ keep @ _turned(keep)
        return np.concatenate([base[..., self.t] - base[..., self.s] @ r, r], -2)

    def error(self, coefficients: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared error, squared target) over other rows, given their sums in these units."""
        x = slice(0, coefficients.shape[-2])
        seen = np.trace(gram[..., self.t, self.t], axis1=-2, axis2=-1)
        return seen - 2 * (coefficients * gram[..., x, self.t]).sum((-1, -2)) + (coefficients * (gram[..., x, x] @ coefficients)).sum((-1, -2)), seen


def _r2(error: float, seen: float) -> float:
    tiny = np.finfo(float).eps
    if seen <= tiny:
        return 0.0 if error <= tiny else -error / tiny
    return 1 - error / seen


def fit_blocks(sums: np.ndarray, widths: tuple[int, int, int], config: NetworkConfig) -> list[list[dict]]:
    """For each block of sums a row for each outer fold: counts, the choices made in its training part, and errors.

    sums[block, k, j]: sums of products of the columns base, source, shifted source, target after a leading 1, over inner fold j of the training part of
    outer fold k; over fold k itself at the last j. The base's penalty comes first, then the source's penalty and rank for it; the shifted source keeps
    them. Equal errors take the larger penalty, before that the lower rank. Blocks of equal widths are solved together.
    """
    nb, ns, nt = widths
    size = 1 + nb + 2 * ns + nt
    real = [*range(1 + nb + ns), *range(1 + nb + 2 * ns, size)]
    shifted = [*range(1 + nb), *range(1 + nb + ns, size)]
    alphas = sorted(config.alphas, reverse=True)
    out: list[list[dict]] = [[] for _ in sums]
    for k in range(config.outer_folds):
        parts, held = sums[:, k, :-1], sums[:, k, -1]
        train = parts.sum(1)
        n, n_held = (np.rint(g[:, 0, 0]).astype(int) for g in (train, held))
        own = parts[..., real, :][..., real]
        m = Moments(train[:, None][..., real, :][..., real] - own, nb, ns)
        own = m.standard(own)
        scale = np.maximum(1, n * nt)
        tried = np.array([m.error(m.base(a)[..., m.t], own)[0].sum(1) / scale for a in alphas])
        base_alpha = np.array(alphas)[tried.argmin(0)]
        base = m.base(base_alpha[:, None])
        ranks = np.array(sorted(r for r in config.ranks if r <= min(ns, nt)) or [1])[:, None]
        fits = ranks <= np.maximum(1, n - 1)  # where too few trials leave none of the ranks, rank 1 stands for the first
        ranks = np.where(fits, ranks, 1)
        fits[0] = True
        added = [m.added(base, a) for a in alphas]
        errors = np.array([np.where(f, m.error(m.full(base, *c, r[:, None]), own)[0].sum(1) / scale, np.inf) for r, f in zip(ranks, fits, strict=True) for c in added])
        best = errors.argmin(0)
        rank, alpha = ranks[best // len(alphas), np.arange(len(n))], np.array(alphas)[best % len(alphas)]
        found = {}
        for name, columns in (("full", real), ("shift", shifted)):
            m = Moments(train[:, columns][..., columns], nb, ns)
            base, own = m.base(base_alpha), m.standard(held[:, columns][..., columns])
            found["base_error"], found["seen"] = m.error(base[..., m.t], own)
            found[f"{name}_error"] = m.error(m.full(base, *m.added(base, alpha), rank), own)[0]
        for i, rows in enumerate(out):
            rows.append({"fold": k, "n_train": int(n[i]), "n_validation": int(n_held[i]), "base_alpha": float(base_alpha[i]), "source_alpha": float(alpha[i]), "rank": int(rank[i]), **{c: float(v[i]) for c, v in found.items()}})
    return out


#: Numbers in the sums that are solved at once, about.
_SOLVED_AT_ONCE = 2_000_000
#: Columns up to which the sums of all parts are one product.
_NARROW = 64
_RESULT = "n_trials bigint, n_source_units int, n_target_units int, base_r2 double, full_r2 double, source_added_r2 double, shift_full_r2 double, shift_source_added_r2 double, real_minus_shift_source_added_r2 double, status string, folds array<struct<fold: int, n_train: bigint, n_validation: bigint, base_alpha: double, source_alpha: double, rank: int, base_r2: double, full_r2: double, shift_full_r2: double>>"


def network_by_block(rows: DataFrame, config: NetworkConfig = NetworkConfig(), *, by: list[str], block: str = "reward_block", time: str = "time", key: str = "id", source: str = "source_values", base: str = "base_values", target: str = "target_values") -> DataFrame:
    """A row for each by and block: trials, units, out-of-fold R2 of the base, with the source, with the shifted source, their differences, the status and the choices by fold.

    rows: one per trial, with arrays of the source's and the target's values and of base columns (covariates and the target's history).
    Each block gets as many trials as the smallest one of its session and pair. status: pass; too_few_trials, if that is under
    min_trials (0 if a block is absent); too_few_units; uneven_values, if arrays have several lengths or missing values. Only pass has figures. R2 is that of
    held-out rows in units of their training part, over all folds.
    """
    ship(rows.sparkSession)
    known = rows.where(F.col(block).isin(*BLOCKS))
    each, whole = Window.partitionBy(*by, block), Window.partitionBy(*by)
    n_blocks = F.size(F.collect_set(block).over(whole))
    sized = known.withColumn("_n", F.count("*").over(each)).withColumns({"_least": F.when(n_blocks == len(BLOCKS), F.min("_n").over(whole)).otherwise(0).cast("bigint"), "_ns": F.coalesce(F.max(F.size(source)).over(whole), F.lit(0)), "_nt": F.coalesce(F.max(F.size(target)).over(whole), F.lit(0))}).drop("_n")
    folds = folded_trials(sized, config, by=by, block=block, time=time, key=key, source=source)
    columns = [base, source, f"shifted_{source}", target]
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    folds = folds.select(*by, block, "_least", "_ns", "_nt", "fold", "inner", usable.alias("_whole"), *[F.col(c).cast("array<double>").alias(c) for c in columns])
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*by, block])
    schema = to_arrow_schema(StructType.fromDDL(f"{kinds}, {_RESULT}"))
    k, j, nk = config.outer_folds, config.inner_folds, len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of products of each block of a session while its rows pass; blocks that are complete wait until many can be solved at once."""
        session: tuple | None = None
        about: tuple[int, int, int] = (0, 0, 0)
        blocks: dict[str, tuple[int, dict[tuple, np.ndarray]]] = {}
        done: list[tuple] = []
        waiting: dict[tuple, list[tuple[int, np.ndarray]]] = {}
        held = 0

        def close() -> None:
            nonlocal held
            least, ns, nt = about
            for name in BLOCKS:
                n, own = blocks.get(name, (0, {}))
                status = "too_few_trials" if least < config.min_trials else "too_few_units" if min(ns, nt) < config.min_units else "uneven_values" if len(own) != 1 or n != least else "pass"
                if status == "pass":
                    ((widths, sums),) = own.items()
                    waiting.setdefault(widths, []).append((len(done), sums))
                    held += sums.size
                done.append([*session, name, n, ns, nt, *[None] * 6, status, None])
            blocks.clear()

        def solved() -> pa.RecordBatch:
            for widths, own in waiting.items():
                for (at, _), found in zip(own, fit_blocks(np.array([g for _, g in own]), (widths[0], widths[1], widths[3]), config), strict=True):
                    of = lambda name, some: _r2(sum(r[f"{name}_error"] for r in some), sum(r["seen"] for r in some))
                    b, full, shift = (of(x, found) for x in ("base", "full", "shift"))
                    done[at][nk + 4 : nk + 10] = b, full, full - b, shift, shift - b, full - shift
                    done[at][-1] = [{**{c: r[c] for c in ("fold", "n_train", "n_validation", "base_alpha", "source_alpha", "rank")}, "base_r2": of("base", [r]), "full_r2": of("full", [r]), "shift_full_r2": of("shift", [r])} for r in found]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            waiting.clear()
            return out

        for batch in batches:
            ok = batch.column(nk + 6).to_numpy(zero_copy_only=False)
            arrays = [batch.column(i) for i in range(nk + 7, nk + 11)]
            widths = np.column_stack([np.where(ok, pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False), -1) for x in arrays])
            ends = [x.offsets.to_numpy() for x in arrays]
            values = [x.values.to_numpy(zero_copy_only=False) for x in arrays]
            inner = batch.column(nk + 5).flatten().to_numpy().reshape(-1, k)
            place = np.where(inner < 0, j, inner)  # the fold itself is the last of its parts
            keys = [pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy() for i in range(nk + 1)]
            turns = np.any([x[1:] != x[:-1] for x in [*keys, *widths.T]], axis=0)
            starts = [0, *(np.flatnonzero(turns) + 1).tolist()] if batch.num_rows else []
            for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                *own, name, least, ns, nt = (batch.column(i)[a].as_py() for i in range(nk + 4))
                if tuple(own) != session:
                    if session is not None:
                        close()
                    if held > _SOLVED_AT_ONCE or len(done) > 3000:
                        yield solved()
                        held = 0
                    session = tuple(own)
                about = least, ns, nt
                n, sums = blocks.get(name, (0, {}))
                if ok[a]:
                    width = tuple(widths[a].tolist())
                    x = np.hstack([np.ones((z - a, 1)), *(v[e[a] : e[z]].reshape(z - a, -1) for v, e in zip(values, ends, strict=True))])
                    if width not in sums:
                        sums[width] = np.zeros((k, j + 1, x.shape[1], x.shape[1]))
                    # a trial's products go to one part of each outer fold; trials of one fold and one set of parts go together
                    if x.shape[1] <= _NARROW:
                        picked = place[a:z, :, None] == np.arange(j + 1)
                        sums[width] += np.moveaxis(picked, 0, -1).reshape(k, j + 1, 1, z - a) * x.T @ x
                    else:
                        for parts in np.unique(place[a:z], axis=0):
                            g = x[(place[a:z] == parts).all(1)]
                            g = g.T @ g
                            for outer, part in enumerate(parts):
                                sums[width][outer, part] += g
                    n += z - a
                blocks[name] = n, sums
        if session is not None:
            close()
        if done:
            yield solved()

    return folds.sortWithinPartitions(*by, block).mapInArrow(run, f"{kinds}, {_RESULT}")
