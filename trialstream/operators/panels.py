"""Source tables of figures: what is drawn, summarised over subjects that count alike, and checks that it agrees with the statistics beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_finite, reversible
from .expect import ExpectationError
from .inference import bootstrap_mean

BLOCKS = ("engaged_1", "no_reward", "engaged_2")


def timing_quartiles(timing: DataFrame, *, by: list[str], values: list[str]) -> DataFrame:
    """Per group (by): how many sessions, and the quartiles of each value, linear between ranks, as <value>_q25, _q50 and _q75."""
    quartiles = [F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{v}") for v in values]
    out = timing.groupBy(*by).agg(F.count("*").alias("n_sessions"), *quartiles)
    return out.select(*by, "n_sessions", *[F.col(f"_{v}")[i].alias(f"{v}_{q}") for v in values for i, q in enumerate(("q25", "q50", "q75"))])


def connected_blocks(blocks: DataFrame, contrasts: DataFrame, *, subject: str, block: str, value: str, sessions: str, contrast: str, contrast_sessions: str) -> DataFrame:
    """blocks (a subject's mean by block and the sessions behind it) with is_connected, reconstructed and difference.

    A line joins a subject's three blocks only if each rests on as many sessions as the subject's contrast; then the contrast
    follows from the drawn values, and difference is what the stored one deviates by. Subjects without a contrast stay, unconnected.
    """
    of = lambda b, c: F.max(F.when(F.col(block) == b, F.col(c)))
    wide = blocks.groupBy(subject).agg(*[of(b, value).alias(f"_v{i}") for i, b in enumerate(BLOCKS)], *[of(b, sessions).alias(f"_n{i}") for i, b in enumerate(BLOCKS)])
    wide = wide.join(contrasts.select(subject, F.col(contrast).alias("_c"), F.col(contrast_sessions).alias("_m")), subject, "left")
    same = reduce(lambda a, b: a & b, [F.col(f"_n{i}") == F.col("_m") for i in range(3)])
    made = reversible(F.col("_v0"), F.col("_v1"), F.col("_v2"))
    joined = F.coalesce(same & made.isNotNull() & F.col("_c").isNotNull(), F.lit(False))
    drawn = wide.select(subject, joined.alias("is_connected"), F.when(joined, made).alias("reconstructed"), F.when(joined, F.col("_c") - made).alias("difference"))
    return blocks.join(drawn, subject)


def panel_summary(subjects: DataFrame, *, by: list[str], subject: str, value: str, seed: int = 0, resamples: int = 10_000, counts: list[str] | None = None) -> DataFrame:
    """Per group (by): n subjects, their mean and its bootstrap interval, and sums of counts. The draws depend on the group's keys, not on the order of groups."""
    boot = bootstrap_mean(subjects, by=by, unit=subject, value=value, seed=seed, resamples=resamples)
    if not counts:
        return boot
    return boot.join(subjects.where(is_finite(value)).groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts]), by)


def complete_rows(panel: DataFrame, grid: DataFrame, *, keys: list[str]) -> DataFrame:
    """The panel's rows of a grid that has to be complete; a cell that is absent or there twice is an error."""
    found = grid.join(panel.withColumn("_here", F.lit(1)), keys, "left")
    count = found.groupBy(*keys).agg(F.count("_here").alias("_n"))
    name = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    checked = count.select(*[F.when(F.col("_n") != 1, F.raise_error(F.concat(F.lit("not one row for "), name)).cast(grid.schema[k].dataType)).otherwise(F.col(k)).alias(k) if i == 0 else F.col(k) for i, k in enumerate(keys)])
    return panel.join(checked, keys, "left_semi")


def panel_mismatches(statistics: DataFrame, panel: DataFrame, *, key: str, estimate: str = "estimate", n: str = "n_mice", mean: str = "mean", size: str = "n", tolerance: float = 1e-9) -> DataFrame:
    """(key, problem) of statistics that don't agree with the drawn values: not_drawn, no_statistic, other_n, other_estimate (beyond tolerance, relative above 1)."""
    both = statistics.select(key, F.col(estimate).alias("_e"), F.col(n).alias("_n"), F.lit(True).alias("_s")).join(panel.select(key, F.col(mean).alias("_m"), F.col(size).alias("_k"), F.lit(True).alias("_p")), key, "full")
    far = F.abs(F.col("_e") - F.col("_m")) > tolerance * F.greatest(F.lit(1.0), F.abs("_m"))
    problem = F.when(F.col("_p").isNull(), "not_drawn").when(F.col("_s").isNull(), "no_statistic").when(~F.col("_n").eqNullSafe(F.col("_k")), "other_n").when(F.coalesce(far, F.col("_e").isNull() != F.col("_m").isNull()), "other_estimate")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def lead_null(null: DataFrame, statistics: DataFrame, *, label: str, lead: str = "is_lead") -> DataFrame:
    """The permuted means of the leading label."""
    return null.join(statistics.where(lead).select(label), label, "left_semi")


def pair_panel(blocks: DataFrame, *, source_region: str, target_region: str, subject: str, block: str, value: str) -> DataFrame:
    """(subject, engaged_1, no_reward, engaged_2, contrast) of one ordered pair of different regions; subjects without all three blocks have no row."""
    if source_region == target_region or not source_region.strip() or not target_region.strip():
        raise ExpectationError("a pair needs two different regions")
    own = blocks.where((F.col("source_region") == source_region) & (F.col("target_region") == target_region))
    wide = own.groupBy(subject).agg(*[F.avg(F.when(F.col(block) == b, F.col(value))).alias(b) for b in BLOCKS])
    return wide.withColumn("contrast", reversible(*map(F.col, BLOCKS))).where(F.col("contrast").isNotNull())


def in_minutes(panel: DataFrame, columns: list[str]) -> DataFrame:
    """panel with seconds as minutes, under names that say so."""
    return panel.withColumns({f"{c}_minutes": F.col(c) / 60 for c in columns}).drop(*columns)
