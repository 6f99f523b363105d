"""Blocks of a session, their boundaries, bins around boundaries, and other windows over ordered rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import is_finite

BLOCKS = ("engaged_1", "no_reward", "engaged_2")


def label_blocks(trials: DataFrame, *, source: str = "source", flag: str = "no_reward", start: str = "start_time", stop: str = "stop_time") -> DataFrame:
    """trials with reward_block: no_reward where flagged, engaged_1 before the first flagged row, engaged_2 after the last; transition for
    rows between and for sessions without a flagged row."""
    own = Window.partitionBy(source)
    first, last = F.min(F.when(F.col(flag), F.col(start))).over(own), F.max(F.when(F.col(flag), F.col(stop))).over(own)
    label = F.when(first.isNull(), "transition").when(F.col(flag), "no_reward").when(F.col(start) < first, "engaged_1").when(F.col(start) >= last, "engaged_2").otherwise("transition")
    return trials.withColumn("reward_block", label)


def run_starts(df: DataFrame, flag: str, *, by: list[str], order: list[str]) -> DataFrame:
    """df with run_start: whether flag is true here and wasn't in the row before."""
    before = F.coalesce(F.lag(flag).over(Window.partitionBy(*by).orderBy(*order)), F.lit(False))
    return df.withColumn("run_start", F.coalesce(F.col(flag), F.lit(False)) & ~before)


def task_structure(trials: DataFrame, *, source: str = "source", index: str = "idx", flag: str = "no_reward", start: str = "start_time", stop: str = "stop_time", block: str = "reward_block") -> DataFrame:
    """Per source: counts of rows, repeated and missing indices, invalid times, unknown flags, runs of the flag, and the conjunction."""
    order = Window.partitionBy(source).orderBy(index)
    marked = run_starts(trials, flag, by=[source], order=[index]).withColumn("_back", F.col(start) < F.lag(start).over(order))
    out = marked.groupBy(source).agg(
        F.count("*").alias("n_trials"), F.countDistinct(index).alias("n_indices"), F.count_if(F.col(index).isNull()).alias("n_missing_indices"),
        F.count_if(~is_finite(start) | ~is_finite(stop)).alias("n_invalid_times"), F.count_if(F.col(stop) <= F.col(start)).alias("n_nonpositive"),
        F.count_if(F.col(flag).isNull()).alias("n_unknown_flags"), F.count_if("run_start").alias("n_runs"), F.count_if("_back").alias("n_decreasing"),
        *[F.count_if(F.col(block) == b).alias(f"n_{b}") for b in BLOCKS],
    )
    ok = (F.col("n_indices") == F.col("n_trials")) & (F.col("n_runs") == 1)
    for c in ("n_missing_indices", "n_invalid_times", "n_nonpositive", "n_unknown_flags", "n_decreasing"):
        ok = ok & (F.col(c) == 0)
    for b in BLOCKS:
        ok = ok & (F.col(f"n_{b}") > 0)
    return out.withColumn("is_valid_structure", ok)


def interval_clock(intervals: DataFrame, *, source: str, index: str, start: str, stop: str, event: str | None = None) -> DataFrame:
    """Per source: missing, non-positive, decreasing and repeated intervals, events outside of theirs (NaN is no event), range and the conjunction."""
    marked = intervals.withColumns({"_back": F.col(start) < F.lag(start).over(Window.partitionBy(source).orderBy(index)), "_same": F.count("*").over(Window.partitionBy(source, start)) > 1})
    outside = F.lit(False) if event is None else is_finite(event) & ((F.col(event) < F.col(start)) | (F.col(event) > F.col(stop)))
    out = marked.groupBy(source).agg(
        F.count("*").alias("n_rows"), F.count_if(~is_finite(start) | ~is_finite(stop)).alias("n_invalid"), F.count_if(F.col(stop) <= F.col(start)).alias("n_nonpositive"),
        F.count_if("_back").alias("n_decreasing"), F.count_if("_same").alias("n_repeated_starts"), F.count_if(outside).alias("n_events_outside"), F.min(start).alias("first_start"), F.max(stop).alias("last_stop"),
    )
    bad = sum((F.col(c) for c in ("n_invalid", "n_nonpositive", "n_decreasing", "n_repeated_starts", "n_events_outside")), F.lit(0))
    return out.withColumn("passes", bad == 0)


def block_windows(trials: DataFrame, *, source: str = "source", tail: float, start: str = "start_time", stop: str = "stop_time", block: str = "reward_block") -> DataFrame:
    """Per source the engaged windows: e1_start, e1_stop, e2_start, e2_stop (the last tail seconds cut) and an ordered status; null where it isn't pass."""
    at = lambda f, b, c: f(F.when(F.col(block) == b, F.col(c)))
    raw = trials.groupBy(source).agg(at(F.min, "engaged_1", start).alias("a"), at(F.max, "engaged_1", stop).alias("b"), at(F.min, "engaged_2", start).alias("c"), (at(F.max, "engaged_2", stop) - tail).alias("d"))
    status = F.when(F.col("a").isNull(), "missing_engaged_1").when(F.col("c").isNull(), "missing_engaged_2").when(F.col("b") <= F.col("a"), "empty_engaged_1").when(F.col("d") <= F.col("c"), "empty_engaged_2").otherwise("pass")
    raw = raw.withColumn("status", status)
    return raw.select(source, "status", *[F.when(F.col("status") == "pass", F.col(k)).alias(n) for k, n in zip("abcd", ("e1_start", "e1_stop", "e2_start", "e2_stop"), strict=True)])


def block_timing(trials: DataFrame, *, source: str = "source", index: str = "idx", start: str = "start_time", stop: str = "stop_time", block: str = "reward_block") -> DataFrame:
    """Per source and block: bounds, duration, offset from the session's start, first and last index, rows."""
    own = trials.withColumn("_first", F.min(start).over(Window.partitionBy(source)))
    out = own.groupBy(source, block).agg(F.min(start).alias("block_start"), F.max(stop).alias("block_stop"), F.min("_first").alias("_first"), F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count("*").alias("n_trials"))
    return out.select(source, block, "block_start", "block_stop", (F.col("block_stop") - F.col("block_start")).alias("duration"), (F.col("block_start") - F.col("_first")).alias("offset"), "first_index", "last_index", "n_trials")


def transition_boundaries(trials: DataFrame, *, source: str = "source", subject: str = "subject", start: str = "start_time", stop: str = "stop_time", block: str = "reward_block") -> DataFrame:
    """Two rows per session, withdrawal and restoration: real boundary, pseudo boundary (the midpoint of the block before), coverage and direction."""
    lo = {b: F.min(F.when(F.col(block) == b, F.col(start))) for b in BLOCKS}
    hi = {b: F.max(F.when(F.col(block) == b, F.col(stop))) for b in BLOCKS}
    bounds = trials.groupBy(source, subject).agg(*[lo[b].alias(f"lo_{b}") for b in BLOCKS], *[hi[b].alias(f"hi_{b}") for b in BLOCKS])

    def row(name: str, pre: str, post: str, sign: int) -> Column:
        a, b, c, d = (F.col(f"{side}_{x}") for x in (pre, post) for side in ("lo", "hi"))
        complete = a.isNotNull() & c.isNotNull()
        return F.struct(
            F.lit(name).alias("transition"), F.lit(pre).alias("pre_block"), F.lit(post).alias("post_block"), F.lit(sign).alias("direction"), F.when(complete, c).alias("real_time"), F.when(complete, (a + b) / 2).alias("pseudo_time"),
            F.when(complete, a).alias("pre_start"), F.when(complete, b).alias("pre_stop"), F.when(complete, d).alias("post_stop"), F.when(complete, "complete").otherwise("missing_block").alias("status"),
        )

    both = F.array(row("withdrawal", "engaged_1", "no_reward", -1), row("restoration", "no_reward", "engaged_2", 1))
    return bounds.select(source, subject, F.explode(both).alias("r")).select(source, subject, "r.*")


def anchors(boundaries: DataFrame, *, source: str = "source", subject: str = "subject") -> DataFrame:
    """Boundaries as one row for each real and pseudo anchor: time, the bounds that cover it, and the blocks around it."""
    real = F.struct(F.lit("real").alias("anchor"), F.col("real_time").alias("anchor_time"), F.col("pre_start").alias("cover_start"), F.col("post_stop").alias("cover_stop"), F.col("pre_block").alias("before_block"), F.col("post_block").alias("after_block"))
    pseudo = F.struct(F.lit("pseudo").alias("anchor"), F.col("pseudo_time").alias("anchor_time"), F.col("pre_start").alias("cover_start"), F.col("pre_stop").alias("cover_stop"), F.col("pre_block").alias("before_block"), F.col("pre_block").alias("after_block"))
    return boundaries.where("status = 'complete'").select(source, subject, "transition", "direction", F.explode(F.array(real, pseudo)).alias("a")).select(source, subject, "transition", "direction", "a.*")


@dataclass(frozen=True)
class BinConfig:
    window: float = 432000.0
    width: float = 86400.0
    trial_window: int = 8
    trial_bin: int = 4
    effect_window: float = 432000.0
    min_go: int = 5
    min_catch: int = 3


def _summary(response: str = "response", latency: str = "latency") -> list[Column]:
    return [F.count("*").alias("n_trials"), F.coalesce(F.sum(F.col(response).cast("int")), F.lit(0)).alias("n_responses"), F.count_if(is_finite(latency)).alias("n_latencies"), F.percentile(F.when(is_finite(latency), F.col(latency)), 0.5).alias("median_latency")]


def _near(trials: DataFrame, marks: DataFrame, source: str, time: str, block: str) -> DataFrame:
    """Trials of an anchor's two blocks that its coverage holds, with rel, their time from the anchor, and side."""
    both = trials.join(marks, source).withColumn("rel", F.col(time) - F.col("anchor_time"))
    side = F.when(F.col("rel") < 0, "pre").otherwise("post")
    inside = (F.col(time) >= F.col("cover_start")) & (F.col(time) < F.col("cover_stop"))
    return both.withColumn("side", side).where(inside & (F.col(block) == F.when(F.col("side") == "pre", F.col("before_block")).otherwise(F.col("after_block"))))


def _finish(found: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    out = grid.join(found, keys, "left").fillna(0, ["n_trials", "n_responses", "n_latencies"])
    usable = F.col("covered") & (F.col("n_trials") > 0)
    return out.withColumns({"response_rate": F.when(usable, F.col("n_responses") / F.nullif(F.col("n_trials"), F.lit(0))), "status": F.when(~F.col("covered"), "not_covered").when(F.col("n_trials") == 0, "no_trials").otherwise("pass")})


def time_bins(trials: DataFrame, marks: DataFrame, config: BinConfig = BinConfig(), *, source: str = "source", subject: str = "subject", time: str = "change_time", block: str = "reward_block") -> DataFrame:
    """Half-open bins by time from each anchor, over a complete grid: counts, rate, median latency, covered, status."""
    marks = marks.where(F.col("anchor_time").isNotNull())
    bins = int(config.window / config.width)
    keys = [source, subject, "transition", "anchor", "bin"]
    near = _near(trials.drop(subject), marks, source, time, block).withColumn("bin", F.floor(F.col("rel") / config.width).cast("int")).where(F.col("bin").between(-bins, bins - 1))
    grid = marks.withColumn("bin", F.explode(F.sequence(F.lit(-bins), F.lit(bins - 1))))
    covered = (F.col("anchor_time") + F.col("bin") * config.width >= F.col("cover_start")) & (F.col("anchor_time") + (F.col("bin") + 1) * config.width <= F.col("cover_stop"))
    return _finish(near.groupBy(*keys).agg(*_summary()), grid.select(*keys, covered.alias("covered")), keys)


def trial_bins(trials: DataFrame, marks: DataFrame, config: BinConfig = BinConfig(), *, source: str = "source", subject: str = "subject", time: str = "change_time", index: str = "idx", block: str = "reward_block") -> DataFrame:
    """Bins by ordinal outward from each anchor (... -2, -1 | 1, 2 ...), trial_bin trials each; a bin is covered if complete.

    Ties in time follow the index: ascending after the anchor, descending before it.
    """
    near = _near(trials.drop(subject), marks, source, time, block)
    own = Window.partitionBy(source, "transition", "anchor", "side")
    ahead, back = F.row_number().over(own.orderBy(time, index)), F.row_number().over(own.orderBy(F.col(time).desc(), F.col(index).desc()))
    near = near.withColumn("ordinal", F.when(F.col("side") == "post", ahead).otherwise(-back)).where(F.abs("ordinal") <= config.trial_window)
    k = F.floor((F.abs("ordinal") - 1) / config.trial_bin).cast("int")
    near = near.withColumn("bin", F.when(F.col("ordinal") > 0, k).otherwise(-1 - k))
    keys = [source, subject, "transition", "anchor", "bin"]
    n = config.trial_window // config.trial_bin
    grid = marks.where(F.col("anchor_time").isNotNull()).withColumn("bin", F.explode(F.sequence(F.lit(-n), F.lit(n - 1)))).select(*keys)
    found = near.groupBy(*keys).agg(*_summary())
    grid = grid.join(found.select(*keys, (F.col("n_trials") == config.trial_bin).alias("covered")), keys, "left").fillna(False, ["covered"])
    return _finish(found, grid, keys)


def effect_windows(trials: DataFrame, marks: DataFrame, config: BinConfig = BinConfig(), *, source: str = "source", subject: str = "subject", time: str = "change_time", block: str = "reward_block", condition: str = "condition") -> DataFrame:
    """The windows just before and after each anchor, by condition (go, catch): counts, rate and whether there are enough trials."""
    near = _near(trials.drop(subject), marks, source, time, block).where((F.col("rel") >= -config.effect_window) & (F.col("rel") < config.effect_window))
    keys = [source, subject, "transition", "anchor", "direction", "side", condition]
    found = near.groupBy(*keys).agg(*_summary())
    least = F.when(F.col(condition) == "go", config.min_go).otherwise(config.min_catch)
    return found.withColumns({"response_rate": F.col("n_responses") / F.nullif(F.col("n_trials"), F.lit(0)), "status": F.when(F.col("n_trials") >= least, "pass").otherwise("too_few_trials")})


def transition_effects(windows: DataFrame, *, source: str = "source", subject: str = "subject", condition: str = "condition") -> DataFrame:
    """Wide: steps at real and pseudo anchors, signed by the direction, and their difference; null where a window doesn't pass."""
    rate = lambda anchor, side: F.max(F.when((F.col("anchor") == anchor) & (F.col("side") == side) & (F.col("status") == "pass"), F.col("response_rate")))
    wide = windows.groupBy(source, subject, "transition", "direction", condition).agg(*[rate(a, s).alias(f"{a}_{s}") for a in ("real", "pseudo") for s in ("pre", "post")], F.sum("n_trials").alias("n_trials"))
    step = lambda a: F.col("direction") * (F.col(f"{a}_post") - F.col(f"{a}_pre"))
    return wide.withColumns({"real_step": step("real"), "pseudo_step": step("pseudo"), "controlled_step": step("real") - step("pseudo"), "is_estimable": (step("real") - step("pseudo")).isNotNull()})


def specificity(effects: DataFrame, *, source: str = "source", subject: str = "subject", condition: str = "condition") -> DataFrame:
    """effects with rows go_minus_catch added; counts add up."""
    of = lambda c, v: F.max(F.when(F.col(condition) == c, F.col(v)))
    both = effects.groupBy(source, subject, "transition", "direction").agg(*[(of("go", c) - of("catch", c)).alias(c) for c in ("real_step", "pseudo_step", "controlled_step")], F.sum("n_trials").alias("n_trials"))
    both = both.withColumn(condition, F.lit("go_minus_catch")).withColumn("is_estimable", F.col("controlled_step").isNotNull())
    return effects.unionByName(both, allowMissingColumns=True)


def exposure_index(df: DataFrame, image: str, *, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with exposure: how often the image was shown so far in its session, null for a null image. parts: partitions to sort in, if Spark's own number would leave large ones."""
    if parts:
        df = df.repartition(parts, *by, image)
    own = Window.partitionBy(*by, image).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("exposure", F.when(F.col(image).isNotNull(), F.count(image).over(own)))


def alternating_half(df: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("half", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % 2)


def zscore(df: DataFrame, values: list[str], *, by: list[str]) -> DataFrame:
    """df with z_<value>: standardised by the population deviation within by; null where that is 0."""
    own = Window.partitionBy(*by)
    return df.withColumns({f"z_{v}": (F.col(v) - F.avg(v).over(own)) / F.nullif(F.stddev_pop(v).over(own), F.lit(0.0)) for v in values})


def contiguous_folds(df: DataFrame, folds: int, *, by: list[str], order: list[str], name: str = "fold") -> DataFrame:
    """df with folds of nearly equal size, contiguous in order within by, the larger ones first."""
    return df.withColumn(name, F.ntile(folds).over(Window.partitionBy(*by).orderBy(*order)) - 1)


def spaced_place(at: str, n: str, m: str):
    """Of the m evenly spaced places floor((i + .5) n / m), the i whose place is the row at (from 0) of n; null if none is. Columns by name."""
    # the first i whose place isn't before this row, in whole numbers; the row is chosen if i's place isn't behind it either
    i = F.expr(f"(2 * CAST({at} AS BIGINT) * {m} + {n} - 1) div (2 * {n})")
    return F.when((2 * i + 1) * F.col(n) < 2 * (F.col(at).cast("bigint") + 1) * F.col(m), i)


def evenly_spaced(df: DataFrame, *, by: list[str], group: str, order: list[str]) -> DataFrame:
    """Rows at evenly spaced places, as many from each group as the smallest group of by has: places floor((i + .5) n / m)."""
    own = Window.partitionBy(*by, group)
    sizes = df.groupBy(*by, group).agg(F.count("*").alias("_n"))
    least = sizes.groupBy(*by).agg(F.min("_n").alias("_m"))
    placed = df.withColumn("_at", F.row_number().over(own.orderBy(*order)) - 1).join(sizes, [*by, group]).join(least, by)
    return placed.where(spaced_place("_at", "_n", "_m").isNotNull()).drop("_at", "_n", "_m")


def cyclic_shift(df: DataFrame, value: str, *, by: list[str], order: list[str]) -> DataFrame:
    """df with shifted_<value>: the value of the row half the group away, around the end."""
    own = Window.partitionBy(*by)
    placed = df.withColumns({"_at": F.row_number().over(own.orderBy(*order)) - 1, "_n": F.count("*").over(own)})
    other = placed.select(*by, F.col("_at").alias("_to"), F.col(value).alias(f"shifted_{value}"))
    return placed.withColumn("_to", (F.col("_at") + F.floor(F.col("_n") / 2)) % F.col("_n")).join(other.withColumn("_to", F.col("_to").cast("bigint")), [*by, "_to"]).drop("_at", "_n", "_to")


def prepared_samples(samples: DataFrame, *, source: str, index: str, time: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(samples, diagnostics): finite samples with one row for each time (the mean), and per source what the raw order had.

    Steps are between finite samples in order of index. status: unavailable with fewer than two times, repaired if rows were invalid, out of order or merged, else pass.
    """
    ok = is_finite(time) & is_finite(value)
    finite = samples.where(ok)
    clean = finite.groupBy(source, time).agg(F.avg(value).alias(value), F.count("*").alias("n_merged"))
    step = F.col(time) - F.lag(time).over(Window.partitionBy(source).orderBy(index))
    steps = finite.withColumn("_step", step).groupBy(source).agg(F.count_if(F.col("_step") < 0).alias("n_decreasing"), F.count_if(F.col("_step") == 0).alias("n_repeated_next"), (F.count("*") - F.countDistinct(time)).alias("n_repeated"), F.countDistinct(time).alias("n_times"))
    seen = samples.groupBy(source).agg(F.count("*").alias("n_raw"), F.count_if(~ok).alias("n_invalid")).join(steps, source, "left").fillna(0)
    status = F.when(F.col("n_times") < 2, "unavailable").when(F.col("n_invalid") + F.col("n_decreasing") + F.col("n_repeated") > 0, "repaired").otherwise("pass")
    return clean, seen.withColumn("status", status)
