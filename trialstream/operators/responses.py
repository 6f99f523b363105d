"""Responses of units by trial and their classes, and rate profiles around events, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import is_finite, stabilized

#: The names of the classes, by the response of largest size, and of what isn't stable.
CLASSES = ("early_sensory", "late_prelick", "action_related")
UNSTABLE = "continuous_only"


def windowed_responses(bins: DataFrame, *, by: list[str], start: float, width: float, response: tuple[float, float], baseline: tuple[float, float], stop: str | None = None, bin: str = "bin", n: str = "n") -> DataFrame:
    """(by, response): variance-stabilised rate in the response window less that in the baseline window, from counts by bin (as histogram_around makes).

    A bin belongs to a window that holds its centre. With stop, a column of by or of the rows, only response bins that end by that time after the event count;
    null where none does. by should name a trial and a unit.
    """
    centre = F.lit(start) + (F.col(bin) + 0.5) * width
    inside = (centre >= response[0]) & (centre < response[1])
    if stop is not None:
        inside = inside & (centre + width / 2 <= F.col(stop) + 1e-9)
    before = (centre >= baseline[0]) & (centre < baseline[1])
    rate = lambda w: stabilized(F.sum(F.when(w, F.col(n)).otherwise(0))) / F.sqrt(F.nullif(F.count_if(w), F.lit(0)) * width)
    return bins.groupBy(*by).agg((rate(inside) - rate(before)).alias("response"))


def counts_response(counts: str, bins: int, *, start: float, width: float, response: tuple[float, float], baseline: tuple[float, float], stop: Column | None = None) -> Column:
    """windowed_responses' response of one row with an array of counts by bin (as histograms_around makes)."""
    centres = [start + (k + 0.5) * width for k in range(bins)]
    n = [F.col(counts)[k] for k in range(bins)]
    total = lambda ks, of: sum((of(k) for k in ks), F.lit(0))
    rate = lambda s, m: stabilized(s) / F.sqrt(F.nullif(m, F.lit(0)) * width)
    inside, before = ([k for k, c in enumerate(centres) if a <= c < b] for a, b in (response, baseline))
    ends = lambda k: F.lit(True) if stop is None else F.lit(centres[k] + width / 2) <= stop + 1e-9
    within = rate(total(inside, lambda k: F.when(ends(k), n[k]).otherwise(0)), total(inside, lambda k: F.when(ends(k), 1).otherwise(0)))
    return within - rate(total(before, lambda k: n[k]), F.lit(len(before)))


def response_classes(trials: DataFrame, *, by: list[str], half: str = "half", early: str = "early", late: str = "late", action: str = "action", responded: str = "responded") -> DataFrame:
    """A row for each unit (by): half_0_class, half_1_class, is_stable, response_class, sign, margin and the mean of each response.

    A half's class is the response whose mean over the half's trials is largest in size, the first of equal ones; action counts in responded
    trials only. A unit is stable if both halves agree in class and in a sign that isn't 0; else its class is continuous_only
    and its sign null. margin: the lesser of the halves' (largest - second) / largest. Null and NaN values are left out of the means; a half without
    some mean has no class and no margin.
    """
    value = lambda c: F.when(is_finite(c), F.col(c).cast("double"))
    own = [value(early), value(late), F.when(F.col(responded), value(action))]
    means = [F.avg(F.when(F.col(half) == h, v)).alias(f"_{h}{i}") for h in (0, 1) for i, v in enumerate(own)]
    units = trials.groupBy(*by).agg(*means, *[F.avg(v).alias(f"{n}_response") for n, v in zip(("early", "late", "action"), own, strict=True)])
    for h in (0, 1):
        parts = F.array(*[F.col(f"_{h}{i}") for i in range(3)])
        sizes = F.transform(parts, F.abs)
        known = F.forall(parts, lambda x: x.isNotNull())
        at = F.array_position(sizes, F.array_max(sizes)).cast("int")
        ordered = F.sort_array(sizes, asc=False)
        units = units.withColumns({
            f"half_{h}_class": F.when(known, F.element_at(F.array(*map(F.lit, CLASSES)), at)), f"_sign{h}": F.when(known, F.signum(F.element_at(parts, at))),
            f"_margin{h}": F.when(known, (ordered[0] - ordered[1]) / F.greatest(ordered[0], F.lit(1e-12))),
        })
    stable = F.coalesce((F.col("half_0_class") == F.col("half_1_class")) & (F.col("_sign0") == F.col("_sign1")) & (F.col("_sign0") != 0), F.lit(False))
    margin = F.when(F.col("_margin0").isNotNull() & F.col("_margin1").isNotNull(), F.least("_margin0", "_margin1"))
    return units.select(
        *by, "half_0_class", "half_1_class", stable.alias("is_stable"), F.when(stable, F.col("half_0_class")).otherwise(UNSTABLE).alias("response_class"),
        F.when(stable, F.col("_sign0")).alias("sign"), margin.alias("margin"), "early_response", "late_response", "action_response",
    )


def class_stability(units: DataFrame, *, by: list[str], session: str) -> DataFrame:
    """Per group of classified units: sessions, units, stable ones and their share, units of each class, mean margin."""
    counts = [F.count_if(F.col("response_class") == c).alias(f"n_{c}") for c in CLASSES]
    out = units.groupBy(*by).agg(F.countDistinct(session).alias("n_sessions"), F.count("*").alias("n_units"), F.count_if("is_stable").alias("n_stable_units"), *counts, F.avg("margin").alias("mean_margin"))
    return out.withColumn("stable_fraction", F.col("n_stable_units") / F.col("n_units"))


def unit_profiles(bins: DataFrame, units: DataFrame, *, session: str, unit: str, block: str, start: float, width: float, baseline: tuple[float, float], bin: str = "bin", n: str = "n", counts: str | None = None, n_bins: int = 0) -> DataFrame:
    """Per unit, block and bin: n_trials, mean rate, its deviation over trials, evoked_rate (less the mean of the baseline's bins) and sign_aligned_rate.

    bins: counts by trial, unit and bin, as histogram_around makes, or with counts an array of n_bins of them by trial and unit, as histograms_around makes; units: session, unit, sign and whatever else describes a unit. All sums are one mergeable
    aggregate. A unit that units doesn't have gets no row; a null sign gives a null sign_aligned_rate.
    """
    rate = lambda c: [(F.avg(c) / width).alias("mean_rate"), (F.stddev_samp(c) / width).alias("rate_deviation")]
    if counts is None:
        rates = bins.groupBy(session, unit, block, bin).agg(F.count("*").alias("n_trials"), *rate(n))
    else:
        by_bin = F.array(*[F.struct(*rate(F.col(counts)[k])) for k in range(n_bins)])
        rates = bins.groupBy(session, unit, block).agg(F.count("*").alias("n_trials"), by_bin.alias("_r")).select(session, unit, block, "n_trials", F.posexplode("_r").alias(bin, "_r")).select(session, unit, block, bin, "n_trials", "_r.*")
    centre = F.lit(start) + (F.col(bin) + 0.5) * width
    own = Window.partitionBy(session, unit, block)
    before = F.avg(F.when((centre >= baseline[0]) & (centre < baseline[1]), F.col("mean_rate"))).over(own)
    rates = rates.withColumns({"bin_center": centre, "evoked_rate": F.col("mean_rate") - before})
    return rates.join(units, [session, unit]).withColumn("sign_aligned_rate", F.col("evoked_rate") * F.col("sign"))


def group_profiles(profiles: DataFrame, *, session: str, subject: str, unit: str, block: str, group: str, bin: str = "bin") -> tuple[DataFrame, DataFrame]:
    """(sessions, subjects): the mean sign-aligned rate of each group's stable units by bin, per session; and the mean over a subject's sessions, with counts."""
    keys = [subject, group, block, bin, "bin_center"]
    stable = profiles.where(F.col("is_stable") & F.col(group).isNotNull())
    sessions = stable.groupBy(session, *keys).agg(F.avg("sign_aligned_rate").alias("mean_rate"), F.countDistinct(unit).alias("n_units"), F.max("n_trials").alias("n_trials"))
    subjects = sessions.groupBy(*keys).agg(F.avg("mean_rate").alias("mean_rate"), F.countDistinct(session).alias("n_sessions"), F.sum("n_units").alias("n_unit_sessions"), F.sum("n_trials").alias("n_trial_sessions"))
    return sessions, subjects
