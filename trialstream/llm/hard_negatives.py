"""Hard-negative mining with Four-Russians scoring.

Vectors become integers. A candidate is kept as the bit planes of its two's complement components, a byte for each
eight dimensions of a plane. For an anchor, a table for each eight dimensions holds the sum of every subset of its components, so a
plane's inner product is one lookup a byte, and shifting and adding the planes from the sign down gives the exact score.

Anchors are a stated query set against all rows. Both are dealt into blocks of bounded size and each pair of blocks is a
group of its own, which keeps the best few candidates of each anchor: first of its label, for the positives, then of the other labels,
once for each positive in the window that its score opens. The few that are left of each block are ranked by windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, ship, written

DIMS = 8
#: All subsets of eight dimensions as rows of bits.
_SUBSETS = (np.arange(256)[:, None] >> np.arange(DIMS) & 1).astype(np.int64)


@dataclass(frozen=True)
class MiningConfig:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    #: A negative's score in per cent of the positive's.
    low_percent: int = 50
    high_percent: int = 95
    #: Rows and anchors of a block at most, on average; a block pair is what a task holds at a time.
    block_rows: int = 4096
    block_anchors: int = 4096
    #: Blocks of rows at least, so that small tables use all cores.
    least_blocks: int = 32
    #: Anchors whose tables are held at a time, and rows that are scored at a time.
    table_anchors: int = 32
    scored_rows: int = 2048


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Rows of integers (n, 8 g) as bytes (n, planes, g), the sign's plane first."""
    shifts = np.arange(planes - 1, -1, -1)
    bits = (values[:, None, :] >> shifts[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), planes, -1, DIMS), axis=3, bitorder="little")[..., 0]


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """Tables (g, 256, a) of anchors (a, 8 g)."""
    parts = anchors.reshape(len(anchors), -1, DIMS)
    return np.ascontiguousarray(np.einsum("sd,agd->gsa", _SUBSETS, parts).astype(dtype))


def scores(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (n, a) of bit planes (n, planes, g) and tables (g, 256, a)."""
    total = np.zeros((len(codes), tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for plane in range(codes.shape[1]):
        total <<= 1
        for group in range(codes.shape[2]):
            np.take(tables[group], codes[:, plane, group], axis=0, out=found, mode="clip")
            if plane:
                total += found
            else:
                total -= found
    return total


class Best:
    """The best few rows of each of many windows of scores, from blocks of rows in order of their ids."""

    def __init__(self, low: list[int], high: list[int], count: int, dtype):
        limits = np.iinfo(dtype)
        self.low, self.high = (np.clip(np.array(x, np.int64), limits.min, limits.max).astype(dtype) for x in (low, high))
        self.count = count
        self.window, self.score, self.row = np.zeros(0, np.int64), np.zeros(0, dtype), np.zeros(0, np.int64)

    def add(self, found: np.ndarray, eligible: np.ndarray, column: np.ndarray, first: int) -> None:
        """found: scores (n, a) of rows first, first + 1, ...; eligible: those that count; column: the a of each window."""
        fits = (found[:, column] >= self.low) & (found[:, column] <= self.high) & eligible[:, column]
        row, window = np.nonzero(fits)
        if not len(row):
            return
        score = np.concatenate([self.score, found[row, column[window]]])
        window, row = np.concatenate([self.window, window]), np.concatenate([self.row, row + first])
        order = np.lexsort((row, -score, window))
        window, score, row = window[order], score[order], row[order]
        starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        place = np.arange(len(window)) - np.repeat(starts, np.diff(np.r_[starts, len(window)]))
        keep, full = place < self.count, place == self.count - 1
        self.window, self.score, self.row = window[keep], score[keep], row[keep]
        # later rows have larger ids, so they have to be better than the last of a full window
        self.low[window[full]] = score[full] + 1


def _prepared(rows: DataFrame, scale: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, q): rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.where(F.col(label_column).isNotNull() & vector.isNotNull() & finite)
    return own.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x).cast("bigint")).alias("q"))


def _ranked(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(rows: DataFrame, config: MiningConfig = MiningConfig(), *, is_anchor: Column | None = None, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor is a condition on id; all rows are anchors by default.

    A row with a null label or vector, or with a null or non-finite component, takes no part. Missing components of shorter vectors are 0.
    Equal scores are ordered by id, null last; rows that share an id, also copies of one row, are rows of their own: each is an anchor or a
    candidate by itself and they tie in an order of no meaning. An anchor without positives, and a positive without negatives, give no row.
    A table in which an inner product could exceed 64 bits is an error. Other columns aren't read.
    """
    spark = rows.sparkSession
    ship(spark)
    is_anchor = F.lit(True) if is_anchor is None else F.coalesce(is_anchor, F.lit(False))
    # written, so that row stays what it is
    kept = written(_prepared(rows, config.scale, id_column, vector_column, label_column).withColumns({"anchor": is_anchor, "row": F.monotonically_increasing_id()}), "vectors")
    about = kept.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("q")).alias("dims"), F.max(F.array_max("q")).alias("top"), F.min(F.array_min("q")).alias("bottom")).first()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not about["anchors"]:
        return spark.createDataFrame([], out)
    size = max(about["top"] or 0, -(about["bottom"] or 0))
    width = -(-max(1, about["dims"]) // DIMS) * DIMS
    if width * size * size >= 1 << 62:
        raise ValueError("inner products of these vectors don't fit 64 bits")
    planes = size.bit_length() + 1
    dtype = np.int32 if width * size * size < 1 << 30 else np.int64
    row_blocks = max(config.least_blocks, -(-about["n"] // config.block_rows))
    anchor_blocks = -(-about["anchors"] // config.block_anchors)

    def padded(column: pa.ChunkedArray) -> np.ndarray:
        return np.array([x + [0] * (width - len(x)) for x in column.to_pylist()], np.int64).reshape(-1, width)

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = bit_planes(padded(batch.column(3)), planes) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in codes], pa.binary())], ["row", "id", "label", "codes"])

    packed = written(kept.select("row", "id", "label", "q").mapInArrow(pack, "row bigint, id bigint, label bigint, codes binary"), "bit-planes")
    block = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    dealt = packed.withColumn("row_block", block(row_blocks, 1)).withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    anchors = kept.where("anchor").withColumn("anchor_block", block(anchor_blocks, 2)).select("anchor_block", F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"), "label", "q")

    def paired(sides: DataFrame, same_label: bool, count: int) -> DataFrame:
        """The best rows of each window of sides, from each pair of blocks. A side has an array of windows (positive_row, positive_id, positive_score, low, high)."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, row, label = (right[c].combine_chunks() for c in ("id", "row", "label"))
            row, label = row.to_numpy(), label.to_numpy()
            order = np.lexsort((row, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            codes = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(len(row), planes, width // DIMS)
            own_row, own_label, windows, vectors = left["anchor_row"].to_numpy(), left["label"].to_numpy(), left["windows"].to_pylist(), padded(left["q"])
            by_label = np.argsort(own_label, kind="stable")
            # anchors of one label at a time if only its rows count, any anchors otherwise
            starts = np.unique(own_label[by_label], return_index=True)[1].tolist() if same_label else [0]
            parts = [by_label[i : min(end, i + config.table_anchors)] for start, end in zip(starts, [*starts[1:], len(by_label)], strict=True) for i in range(start, end, config.table_anchors)]
            anchor, opened, score, hit = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in parts:
                tables = subset_sums(vectors[part], dtype)
                pairs = [(k, w) for k, a in enumerate(part.tolist()) for w in windows[a]]
                column = np.array([k for k, _ in pairs], np.int64)
                best = Best([w["low"] for _, w in pairs], [w["high"] for _, w in pairs], count, dtype)
                candidates = order[label[order] == own_label[part[0]]] if same_label else order
                for i in range(0, len(candidates), config.scored_rows):
                    chosen = candidates[i : i + config.scored_rows]
                    eligible = row[chosen][:, None] != own_row[part] if same_label else label[chosen][:, None] != own_label[part]
                    best.add(scores(codes[chosen], tables), eligible, column, i)
                anchor.append(part[column[best.window]])
                opened += [pairs[k][1] for k in best.window.tolist()]
                score.append(best.score.astype(np.int64))
                hit.append(candidates[best.row])
            anchor, hit = pa.array(np.concatenate(anchor)), pa.array(np.concatenate(hit))
            own = {k: pa.array([w[k] for w in opened], pa.int64()) for k in ("positive_row", "positive_id", "positive_score")}
            return pa.table({**{k: left[k].combine_chunks().take(anchor) for k in ("anchor_row", "anchor_id")}, **own, "score": np.concatenate(score), "id": ids.take(hit), "row": right["row"].combine_chunks().take(hit)})

        kind = "anchor_row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, positive_score bigint, score bigint, id bigint, row bigint"
        spread = sides.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        return spread.groupBy("row_block", "anchor_block").cogroup(dealt.groupBy("row_block", "anchor_block")).applyInArrow(run, kind)

    window = lambda **x: F.array(F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in x.items())))
    wide = anchors.withColumn("windows", window(positive_row=None, positive_id=None, positive_score=None, low=-(1 << 62), high=1 << 62))
    positives = _ranked(paired(wide, True, config.positives), ["anchor_row"], config.positives)
    # 100 n >= low p and 100 n <= high p in whole numbers
    low = F.ceil(F.col("score").cast("decimal(38,0)") * config.low_percent / 100).cast("bigint")
    high = F.floor(F.col("score").cast("decimal(38,0)") * config.high_percent / 100).cast("bigint")
    opened = F.struct(F.col("row").alias("positive_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high"))
    opened = positives.groupBy("anchor_row").agg(F.collect_list(opened).alias("windows"))
    negatives = _ranked(paired(anchors.join(opened, "anchor_row"), False, config.negatives), ["anchor_row", "positive_row"], config.negatives)
    return negatives.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
