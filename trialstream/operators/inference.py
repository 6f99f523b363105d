"""Inference by group: Holm adjustment, bootstrap, sign flips, permutation, and scores of predictions.

Draws come from a hash of (seed, group, resample, draw), so results don't depend on partitions and any
engine can repeat them. Resamples are rows and spread over tasks; a group's values travel as one array.
"""

from __future__ import annotations

import json
from dataclasses import asdict, astuple, dataclass, fields
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import is_finite, portable_draw
from .expect import statistics_table

TOLERANCE = 8 * 2.220446049250313e-16


def holm(df: DataFrame, p: str = "p_value", *, family: list[str], order: list[str], name: str = "adjusted_p") -> DataFrame:
    """df with the step-down Holm adjustment within each family; null p stay null and don't count. Ties follow order."""
    known = F.col(p).isNotNull()
    own = Window.partitionBy(*family)
    rank = F.row_number().over(own.orderBy(F.col(p).asc_nulls_last(), *order))
    size = F.count(p).over(own)
    raw = df.withColumn("_raw", F.when(known, F.least(F.lit(1.0), (size - rank + 1) * F.col(p)))).withColumn("_rank", rank)
    return raw.withColumn(name, F.when(known, F.max("_raw").over(own.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw", "_rank")


def value_arrays(df: DataFrame, *, by: list[str], unit: str, value: str) -> DataFrame:
    """(by, n, mean, vs): finite values of each group in order of unit. A group's units are subjects, of which there are few."""
    own = df.where(is_finite(value)).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(value).cast("double").alias("v")))).alias("s"))
    return own.select(*by, F.size("s").alias("n"), F.transform("s", lambda x: x["v"]).alias("vs")).withColumn("mean", F.aggregate("vs", F.lit(0.0), lambda a, x: a + x) / F.col("n"))


def _spread(df: DataFrame, n: int, name: str) -> DataFrame:
    """df times the numbers from 0 to n - 1, dealt over tasks in parts of 1,000."""
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 1000)))).repartition("_part")
    return parts.withColumn(name, F.explode(F.sequence(F.col("_part") * 1000, F.least(F.col("_part") * 1000 + 999, F.lit(n - 1))))).drop("_part")


def bootstrap_mean(df: DataFrame, *, by: list[str], unit: str, value: str, seed: int = 0, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """(by, n, mean, ci_low, ci_high): percentile bootstrap of the mean over units, linear quantiles. With one unit the interval is null."""
    own = value_arrays(df, by=by, unit=unit, value=value)
    drawn = _spread(own.where("n >= 2"), resamples, "rep")
    key = [F.col(c) for c in by]
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda a, i: a + F.element_at(F.col("vs"), (portable_draw(F.col("n"), F.lit(seed), *key, F.col("rep"), i) + 1).cast("int")))
    means = drawn.select(*by, (total / F.col("n")).alias("m"))
    tail = (1 - confidence) / 2
    bounds = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return own.select(*by, "n", "mean").join(bounds, by, "left").select(*by, "n", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def sign_flip(df: DataFrame, *, by: list[str], unit: str, value: str, null_value: float = 0.0, seed: int = 0, exact_up_to: int = 20, resamples: int = 100_000) -> DataFrame:
    """(by, n, p_value, method): two-sided sign-flip test of the mean; all 2^n flips up to exact_up_to units, else random ones with one added to both counts.

    Fewer than two units have a null p.
    """
    own = value_arrays(df.withColumn(value, F.col(value) - null_value), by=by, unit=unit, value=value)
    flipped = lambda bit: F.aggregate(F.zip_with("vs", F.sequence(F.lit(0), F.col("n") - 1), lambda x, i: F.when(bit(i) == 1, x).otherwise(-x)), F.lit(0.0), lambda a, x: a + x)
    seen = F.abs(F.aggregate("vs", F.lit(0.0), lambda a, x: a + x))
    extreme = lambda total: F.count_if(F.abs(total) >= seen_col - TOLERANCE * F.greatest(F.lit(1.0), seen_col))
    seen_col = F.col("_seen")
    own = own.withColumn("_seen", seen)
    exact = own.where((F.col("n") >= 2) & (F.col("n") <= exact_up_to)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.pow(F.lit(2.0), "n") - 1) / 1024).cast("int"))))).repartition("_part")
    exact = exact.withColumn("flip", F.explode(F.sequence(F.col("_part").cast("bigint") * 1024, F.least(F.col("_part").cast("bigint") * 1024 + 1023, F.pow(F.lit(2.0), "n").cast("bigint") - 1))))
    exact = exact.select(*by, "n", "_seen", flipped(lambda i: F.shiftright("flip", 0).bitwiseAND(F.pow(F.lit(2.0), i).cast("bigint")) / F.pow(F.lit(2.0), i)).alias("t"))
    exact = exact.groupBy(*by, "n").agg((extreme(F.col("t")) / F.count("*")).alias("p_value"), F.lit("exact").alias("method"))
    key = [F.col(c) for c in by]
    drawn = _spread(own.where(F.col("n") > exact_up_to), resamples, "rep").select(*by, "n", "_seen", flipped(lambda i: portable_draw(F.lit(2), F.lit(seed), *key, F.col("rep"), i)).alias("t"))
    drawn = drawn.groupBy(*by, "n").agg(((extreme(F.col("t")) + 1) / (F.count("*") + 1)).alias("p_value"), F.lit("sampled").alias("method"))
    few = own.where("n < 2").select(*by, "n", F.lit(None).cast("double").alias("p_value"), F.lit("too_few").alias("method"))
    return reduce(DataFrame.unionByName, (exact, drawn, few))


def statistic_rows(df: DataFrame, metrics: list[str], *, by: list[str], unit: str, family: str = "metric", seed: int = 0, resamples: int = 10_000, flips: int = 100_000, null_value: float = 0.0) -> DataFrame:
    """One row for each group and metric: estimate, interval, p, Holm-adjusted p within family, and status."""
    long = df.select(*by, unit, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")).select(*by, unit, "r.*")
    keys = [*by, "metric"]
    boot = bootstrap_mean(long, by=keys, unit=unit, value="value", seed=seed, resamples=resamples)
    flip = sign_flip(long, by=keys, unit=unit, value="value", null_value=null_value, seed=seed, resamples=flips)
    every = long.select(*keys).distinct()
    out = every.join(boot, keys, "left").join(flip.select(*keys, "p_value", "method"), keys, "left").fillna(0, ["n"])
    out = holm(out, family=[family], order=keys)
    return out.withColumn("status", F.when(F.col("n") >= 2, "estimated").when(F.col("n") == 1, "point_only").otherwise("not_estimable"))


@dataclass(frozen=True)
class Statistic:
    """What a row of a statistics table says, beside its figures. A tested one is compared with null_value and adjusted within its family."""

    result_id: str
    metric: str
    contrast_id: str
    hypothesis: str
    scale: str
    tier: str = "exploratory"
    null_value: float = 0.0
    family: str | None = None
    tested: bool = False
    notes: str | None = None


def specified_statistics(estimates: DataFrame, specification: list[Statistic], *, metric: str = "metric", unit: str = "subject", value: str = "value", counts: dict[str, str] | None = None, provenance: dict[str, str] | None = None, seed: int = 0, resamples: int = 10_000, flips: int = 100_000, exact_up_to: int = 20, confidence: float = 0.95) -> DataFrame:
    """The statistics table of a specification: a row for each of its results, all from one plan.

    estimates: (metric, unit, value) and columns that counts maps to the table's n_sessions, n_units and n_trials; they are summed over the units whose value counts.
    Several results may rest on one metric. Each has an estimate and an interval, and, if tested, a sign-flip test against its null value with Holm
    adjustment in its family. status: estimated; point_only with one unit and not_estimable without any, with the reason. A metric that estimates lack is not estimable.
    provenance fills text columns of all rows (data_version, code_version, inclusion_definition, ...); config_hash is a digest of the specification and the settings. Draws
    depend on seed and result_id only.
    """
    spark = estimates.sparkSession
    names = [f.name for f in fields(Statistic)]
    spec = spark.createDataFrame([astuple(s) for s in specification], "result_id string, metric string, contrast_id string, hypothesis string, scale string, tier string, null_value double, family string, tested boolean, notes string")
    if len({s.result_id for s in specification}) != len(specification):
        raise ValueError("result_id must be unique")
    digest = sha256(json.dumps([[asdict(s) for s in specification], seed, resamples, flips, exact_up_to, confidence], sort_keys=True).encode()).hexdigest()
    counts = counts or {}
    long = estimates.where(is_finite(value)).select(F.col(metric).alias("metric"), F.col(unit).alias("unit"), F.col(value).cast("double").alias("value"), *[F.col(c).cast("bigint").alias(n) for n, c in counts.items()])
    long = long.join(spec.select("result_id", "metric", "null_value", "tested"), "metric")
    sums = long.groupBy("result_id").agg(F.count("*").alias("n_mice"), *[F.sum(n).alias(n) for n in counts])
    boot = bootstrap_mean(long, by=["result_id"], unit="unit", value="value", seed=seed, resamples=resamples, confidence=confidence).withColumnRenamed("mean", "estimate").drop("n")
    centred = long.where("tested").withColumn("value", F.col("value") - F.col("null_value"))
    test = sign_flip(centred, by=["result_id"], unit="unit", value="value", seed=seed, exact_up_to=exact_up_to, resamples=flips).select("result_id", "p_value", "method")
    out = spec.join(sums, "result_id", "left").join(boot, "result_id", "left").join(test, "result_id", "left").fillna(0, ["n_mice"])
    out = holm(out, family=["family"], order=["result_id"])
    n, inner = F.col("n_mice"), F.col("ci_low").isNotNull()
    status = F.when(n >= 2, "estimated").when(n == 1, "point_only").otherwise("not_estimable")
    out = out.select(
        *[c for c in names if c not in ("family", "tested")], status.alias("status"), F.when(n == 1, "one_unit").when(n == 0, "no_values").alias("status_reason"), "estimate", "ci_low", "ci_high", *["n_mice", *counts],
        F.when(inner, F.lit(confidence)).alias("confidence_level"), F.when(inner, "percentile_bootstrap").alias("ci_method"), F.when(inner, F.lit(resamples)).alias("n_bootstrap"), "p_value", F.col("adjusted_p").alias("adjusted_p_value"),
        F.when(F.col("p_value").isNotNull(), "two_sided").alias("sidedness"), F.when(F.col("p_value").isNotNull(), F.concat(F.lit("sign_flip_"), F.col("method"))).alias("test_method"), F.when(F.col("method") == "sampled", F.lit(flips)).when(F.col("method") == "exact", F.pow(F.lit(2.0), n)).alias("n_resamples"),
        F.when(F.col("tested"), F.col("family")).alias("multiplicity_family"), F.when(F.col("adjusted_p").isNotNull(), "holm").alias("multiplicity_method"), F.lit(seed).alias("seed"), F.lit(digest).alias("config_hash"), *[F.lit(v).alias(k) for k, v in (provenance or {}).items()],
    )
    return statistics_table(out)


def permutation_null(rows: DataFrame, *, session: str, subject: str, unit: str, label: str, value: str, permutations: int, seed: int = 0) -> DataFrame:
    """(label, rep, mean): values permuted over labels within sessions; session mean, subject mean, then the mean over subjects.

    A session's labels and values are packed once, as one row in order of unit. A permutation orders the packed values by a hash of (seed, rep, session,
    unit), lays them along the labels and leaves a mean for each label, so tables are neither copied nor sorted nor joined again for it. A null label takes part
    in the permutation and has no row; null values count in no mean; a session with several subjects is an error.
    """
    one = F.when(F.countDistinct(subject) > 1, F.raise_error(F.concat(F.lit("a session with several subjects: "), F.col(session).cast("string")))).otherwise(F.first(subject))
    packed = rows.groupBy(session).agg(one.alias(subject), F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(label).alias("l"), F.col(value).cast("double").alias("v")))).alias("_p"))
    packed = packed.withColumn("_labels", F.array_compact(F.array_distinct(F.transform("_p", lambda x: x["l"]))))
    spread = _spread(packed, permutations, "rep")
    order = F.array_sort(F.transform("_p", lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(seed), "rep", session, x["u"])).alias("h"), x["u"].alias("u"), x["v"].alias("v"))))
    mixed = spread.withColumn("_m", F.zip_with("_p", order, lambda x, o: F.struct(x["l"].alias("l"), o["v"].alias("v"))))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
    added = lambda l: F.aggregate(F.filter("_m", lambda x: (x["l"] == l) & x["v"].isNotNull()), zero, lambda a, x: F.struct((a["s"] + x["v"]).alias("s"), (a["n"] + 1).alias("n")))  # noqa: E731, E741
    sums = mixed.select(subject, "rep", F.explode(F.transform("_labels", lambda l: F.struct(l.alias("l"), added(l).alias("t")))).alias("r"))  # noqa: E741
    by_session = sums.select(subject, "rep", F.col("r.l").alias(label), (F.col("r.t.s") / F.nullif(F.col("r.t.n"), F.lit(0))).alias("m"))
    return by_session.groupBy("rep", label, subject).agg(F.avg("m").alias("m")).groupBy(label, "rep").agg(F.avg("m").alias("mean"))


def permutation_test(rows: DataFrame, *, session: str, subject: str, unit: str, label: str, value: str, permutations: int = 1000, seed: int = 0) -> DataFrame:
    """(label, observed, p_value, adjusted_p): how often a permuted mean is at least as far from the null's mean as the observed one."""
    seen = rows.groupBy(label, subject, session).agg(F.avg(value).alias("m")).groupBy(label, subject).agg(F.avg("m").alias("m")).groupBy(label).agg(F.avg("m").alias("observed"))
    null = permutation_null(rows, session=session, subject=subject, unit=unit, label=label, value=value, permutations=permutations, seed=seed)
    centre = null.groupBy(label).agg(F.avg("mean").alias("centre"))
    both = null.join(seen, label).join(centre, label)
    far = F.abs(F.col("mean") - F.col("centre")) >= F.abs(F.col("observed") - F.col("centre")) - 1e-12
    out = both.groupBy(label, "observed").agg(((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p_value"))
    return holm(out.withColumn("family", F.lit("labels")), family=["family"], order=[label]).drop("family")


def binary_auc(df: DataFrame, score: str, target: str, *, by: list[str]) -> DataFrame:
    """(by, auc): probability that a positive scores higher, ties a half, by average ranks; null without both classes."""
    own = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.rank().over(own.orderBy(score)) + (F.count("*").over(Window.partitionBy(*by, score)) - 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum(F.when(F.col(target), F.col("_r"))).alias("s"), F.count_if(target).alias("p"), F.count_if(~F.col(target)).alias("q"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def r_squared(df: DataFrame, observed: str, predicted: str, *, by: list[str]) -> DataFrame:
    """(by, r2): 1 - SSE / SS about the mean; 0 where nothing varies and the fit is exact, null where it isn't."""
    out = df.groupBy(*by).agg(F.sum((F.col(observed) - F.col(predicted)) ** 2).alias("e"), (F.var_pop(observed) * F.count(observed)).alias("s"))
    return out.select(*by, F.when(F.col("s") > 0, 1 - F.col("e") / F.col("s")).when(F.col("e") == 0, 0.0).alias("r2"))


def balanced_mse(df: DataFrame, predicted: str, target: str, *, by: list[str]) -> DataFrame:
    """(by, mse): squared error to +-0.5, each class weighing half."""
    error = (F.col(predicted) - F.when(F.col(target), 0.5).otherwise(-0.5)) ** 2
    return df.groupBy(*by).agg((0.5 * F.avg(F.when(F.col(target), error)) + 0.5 * F.avg(F.when(~F.col(target), error))).alias("mse"))


def balanced_moments(df: DataFrame, value: str, target: str, *, by: list[str]) -> DataFrame:
    """(by, location, scale): mean and deviation with each class weighing half; a tiny scale becomes 1."""
    half = lambda e: 0.5 * F.avg(F.when(F.col(target), e)) + 0.5 * F.avg(F.when(~F.col(target), e))
    out = df.groupBy(*by).agg(half(F.col(value)).alias("location"), half(F.col(value) ** 2).alias("square"))
    scale = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("location") ** 2))
    return out.select(*by, "location", F.when(scale > 1e-12, scale).otherwise(1.0).alias("scale"))


def balanced_weights(df: DataFrame, target: str, *, by: list[str]) -> DataFrame:
    return df.withColumn("weight", 0.5 / F.count("*").over(Window.partitionBy(*by, target)))


def nominate(df: DataFrame, estimate: str = "mean", *, low: str = "ci_low", adjusted: str = "adjusted_p", order: list[str]) -> DataFrame:
    """df with rank by estimate, is_lead (the best one, ties by order) and screen_status."""
    rank = F.row_number().over(Window.orderBy(F.col(estimate).desc_nulls_last(), *order))
    ok = (F.col(estimate) > 0) & (F.col(low) > 0)
    return df.withColumns({"rank": rank, "is_lead": rank == 1, "screen_status": F.when(F.coalesce(ok & (F.col(adjusted) < 0.05), F.lit(False)), "pass").when(F.coalesce(ok, F.lit(False)), "fragile").otherwise("null")})
