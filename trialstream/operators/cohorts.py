"""Balanced allocation of subjects to two cohorts, by exhaustive search over all splits.

A feature's values are scaled to integers by the caller, so that sums are exact and ties are real ties. Splits are numbers:
each task unranks its range of them and returns the best one it saw, so nothing is made or moved but one row a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import expect as X


@dataclass(frozen=True)
class AllocationConfig:
    confirmation: int = 6
    seed: str = "20240101"
    #: More splits than this are an error: the search is exhaustive.
    max_splits: int = 10**9
    #: Splits that a task scores at a time.
    batch: int = 1 << 14


def subject_features(sessions: DataFrame, *, subject: str, categories: list[str], numbers: list[str], coverage: DataFrame | None = None) -> DataFrame:
    """(subject, family, feature, value): an indicator for each category's value and each number as it is; coverage adds rows of the same columns."""
    rows = [F.struct(F.lit(c).alias("family"), F.concat_ws("=", F.lit(c), F.col(c).cast("string")).alias("feature"), F.lit(1).cast("bigint").alias("value")) for c in categories]
    seen = sessions.select(subject, F.explode(F.array(*rows)).alias("r")).select(subject, "r.*")
    grid = sessions.select(subject).distinct().join(F.broadcast(seen.select("family", "feature").distinct()))
    out = grid.join(seen, [subject, "family", "feature"], "left").fillna(0, ["value"])
    plain = [F.struct(F.lit("numeric").alias("family"), F.lit(n).alias("feature"), F.col(n).cast("bigint").alias("value")) for n in numbers]
    if plain:
        out = out.unionByName(sessions.select(subject, F.explode(F.array(*plain)).alias("r")).select(subject, "r.*"))
    return out if coverage is None else out.unionByName(coverage)


def varying(features: DataFrame, *, subject: str) -> DataFrame:
    """features without those of one value."""
    several = features.groupBy("family", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi").select("family", "feature")
    return features.join(several, ["family", "feature"], "left_semi")


def unranked(ranks: np.ndarray, n: int, k: int) -> np.ndarray:
    """Rows of k increasing places below n: the subsets with these ranks in lexicographic order."""
    left, need = ranks.astype(np.int64), np.full(len(ranks), k)
    out, filled = np.zeros((len(ranks), k), np.int64), np.zeros(len(ranks), np.int64)
    for place in range(n):
        # subsets that take this place, for each number still needed
        with_it = np.array([math.comb(n - place - 1, r - 1) if r else 0 for r in range(k + 1)], np.int64)[need]
        take = (need > 0) & (left < with_it)
        left = np.where(take | (need == 0), left, left - with_it)
        out[take, filled[take]] = place
        filled += take
        need -= take
    return out


class Scores:
    """Objectives of splits of n subjects: mean over families of the mean squared standardised difference between the k members and the others.

    With integer values each squared difference is (n p - k s)^2 times a constant of the feature (p: sum of the members, s: of all), so
    objectives are integers over one denominator. Floats find what comes near the least one, integers decide.
    """

    def __init__(self, values: np.ndarray, families: list[str], k: int):
        self.values, self.k, self.n = values, k, len(values)
        n, total = self.n, values.sum(axis=0)
        spread = [int(n * (v.astype(object) ** 2).sum() - int(v.sum()) ** 2) for v in values.T]
        sizes = {f: families.count(f) for f in families}
        parts = [Fraction(1, x * sizes[f] * len(sizes)) for x, f in zip(spread, families, strict=True)]
        self.below = reduce(math.lcm, (p.denominator for p in parts))
        self.weights = [int(p * self.below) for p in parts]
        self.below_worst = reduce(math.lcm, spread)
        self.worst_weights = [self.below_worst // x for x in spread]
        self.total = [int(x) for x in total]
        #: What both are to be multiplied by: n (n - 1) / (k (n - k))^2.
        self.factor = Fraction(n * (n - 1), (k * (n - k)) ** 2)

    def gaps(self, members: np.ndarray) -> np.ndarray:
        return self.n * self.values[members].sum(axis=1, dtype=np.float64) - self.k * np.array(self.total, np.float64)

    def rough(self, members: np.ndarray) -> np.ndarray:
        return self.gaps(members) ** 2 @ (np.array(self.weights, object) / self.below).astype(float)

    def exact(self, members: list[int]) -> tuple[int, int]:
        """(objective, largest squared difference), as integers over below and below_worst, without the factor."""
        sums = [sum(int(v) for v in column[members]) for column in self.values.T]
        squares = [(self.n * p - self.k * t) ** 2 for p, t in zip(sums, self.total, strict=True)]
        return sum(q * w for q, w in zip(squares, self.weights, strict=True)), max(q * w for q, w in zip(squares, self.worst_weights, strict=True))


def allocate(features: DataFrame, config: AllocationConfig = AllocationConfig(), *, subject: str) -> DataFrame:
    """One row: members of the confirmation cohort, objective, worst, how many splits there were and how many tied.

    Ties go by the largest difference, then by a hash of the seed and the members, then by name; all of it is exact. features: (subject, family, feature,
    value), which the search holds whole, since an exhaustive search has few subjects. Without a feature that varies, with a subject that lacks one or has it twice, or with too few
    subjects it is an error.
    """
    spark = features.sparkSession
    ship(spark)
    rows = varying(features, subject=subject).select(F.col(subject).cast("string").alias("s"), "family", "feature", F.col("value").cast("bigint").alias("value")).collect()
    names = sorted(r["s"] for r in features.select(F.col(subject).cast("string").alias("s")).distinct().collect() if r["s"] is not None)
    keys = sorted({(r["family"], r["feature"]) for r in rows})
    n, k = len(names), config.confirmation
    if not keys:
        raise ValueError("no feature varies over the subjects")
    if not 0 < k < n:
        raise ValueError(f"{n} subjects can't be split into {k} and others")
    if len(rows) != n * len(keys) or len({(r["s"], r["family"], r["feature"]) for r in rows}) != len(rows):
        raise ValueError("every subject needs one value of every feature")
    if math.comb(n, k) > config.max_splits:
        raise ValueError(f"{math.comb(n, k)} splits are too many to try")
    values = np.zeros((n, len(keys)), np.int64)
    for r in rows:
        values[names.index(r["s"]), keys.index((r["family"], r["feature"]))] = r["value"]
    scores = Scores(values, [f for f, _ in keys], k)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The task's best split by all criteria, and how many of its splits have its objective, and its largest difference too."""
        count, least, found = 0, math.inf, []
        for frame in frames:
            for i in range(0, len(frame), config.batch):
                members = unranked(frame["id"].to_numpy()[i : i + config.batch], n, k)
                rough = scores.rough(members)
                count += len(members)
                least = min(least, float(rough.min()))
                close = np.flatnonzero(rough <= least * (1 + 1e-9))
                own = [(*scores.exact(members[j]), members[j]) for j in close]
                if own:
                    top = min(own, key=lambda x: x[:2])[0]
                    if found and found[0][0] <= top:
                        top = found[0][0]
                    found = [x for x in [*found, *own] if x[0] == top]
        if not found:
            return
        second = min(x[1] for x in found)
        twice = [x for x in found if x[1] == second]
        named = [[names[i] for i in x[2]] for x in twice]
        tied = min((hashlib.sha256("|".join([config.seed, ",".join(m)]).encode()).hexdigest(), m) for m in named)
        # integers of any size in order as text
        text = lambda x: f"{len(str(x)):06d}:{x}"
        yield pd.DataFrame([(text(found[0][0]), text(second), *tied, float(scores.factor * Fraction(found[0][0], scores.below)), float(scores.factor * Fraction(second, scores.below_worst)), count, len(found), len(twice))], columns=["o", "w", "tie", "members", "objective", "worst", "n", "n_o", "n_w"])

    tasks = max(1, min(math.comb(n, k) // config.batch, 4 * spark.sparkContext.defaultParallelism))
    parts = spark.range(0, math.comb(n, k), 1, tasks).mapInPandas(best, "o string, w string, tie string, members array<string>, objective double, worst double, n bigint, n_o bigint, n_w bigint")
    # a row a task: the least one, with counts of those tasks that have as good a one
    gathered = parts.agg(F.sort_array(F.collect_list(F.struct("o", "w", "tie", "members", "objective", "worst", "n", "n_o", "n_w"))).alias("r"))
    top = F.col("r")[0]
    total = lambda c, keep: F.aggregate(F.filter("r", keep), F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    return gathered.select(
        top["members"].alias("members"), F.round(top["objective"], 12).alias("objective"), F.round(top["worst"], 12).alias("worst"), total("n", lambda x: F.lit(True)).alias("n_candidates"),
        total("n_o", lambda x: x["o"] == top["o"]).alias("n_tied"), total("n_w", lambda x: (x["o"] == top["o"]) & (x["w"] == top["w"])).alias("n_tied_twice"),
    )


def input_violations(sessions: DataFrame, quality: DataFrame, *, session: str, subject: str, constant: list[str], selected: str = "is_good_session", criteria: list[str] | None = None, subjects: int | None = None) -> DataFrame:
    """(rule, n_violations) of what an allocation needs: sessions (one row each, with metadata) and their quality.

    Unique session keys and named subjects in both; the same sessions and subjects in both; metadata (constant) of one value within a subject and never null; every
    criterion present and selected a boolean; and, if subjects is given, so many of them with a selected session.
    """
    if quality.schema[selected].dataType.simpleString() != "boolean":
        raise TypeError(f"{selected} must be boolean")
    named = F.trim(F.col(subject).cast("string")) != ""
    rules = [
        X.expect_unique(sessions, [session], "unique_session"), X.expect_unique(quality, [session], "unique_quality_session"), X.expect_rows(sessions, {"named_subject": named, **{f"known_{c}": F.col(c).isNotNull() for c in constant}}),
        X.expect_rows(quality, {"named_quality_subject": named, "known_selection": F.col(selected).isNotNull(), **{f"known_{c}": F.col(c).isNotNull() for c in criteria or []}}),
        X.expect_coverage(sessions, quality, [session], "same_sessions"), X.expect_coverage(sessions, quality, [session, subject], "same_subjects"), X.expect_constant(sessions, [subject], constant, "constant_metadata"),
    ]
    if subjects is not None:
        eligible = quality.where(selected).agg(F.countDistinct(subject).alias("n"))
        rules.append(eligible.select(F.lit("eligible_subjects").alias("rule"), F.abs(F.col("n") - subjects).alias("n_violations")))
    return X.all_of(*rules)


def balance_table(features: DataFrame, chosen: DataFrame, *, subject: str) -> DataFrame:
    """(family, feature, mean_confirmation, mean_discovery, smd) of the chosen split."""
    own = varying(features, subject=subject).join(F.broadcast(chosen.select("members")))
    inside = F.array_contains("members", F.col(subject).cast("string"))
    out = own.groupBy("family", "feature").agg(F.avg(F.when(inside, F.col("value"))).alias("mean_confirmation"), F.avg(F.when(~inside, F.col("value"))).alias("mean_discovery"), F.var_samp("value").alias("v"))
    return out.select("family", "feature", "mean_confirmation", "mean_discovery", ((F.col("mean_discovery") - F.col("mean_confirmation")) / F.sqrt("v")).alias("smd"))


def assign(sessions: DataFrame, chosen: DataFrame, *, subject: str, good: str = "is_good_session") -> DataFrame:
    """Sessions with their subject's cohort, whether they are active and an ordered reason if not."""
    out = sessions.join(F.broadcast(chosen.select("members")))
    cohort = F.when(F.array_contains("members", F.col(subject).cast("string")), "confirmation").otherwise("discovery")
    active = F.coalesce(F.col(good), F.lit(False)) & (cohort == "discovery")
    return out.withColumns({"cohort": cohort, "is_active": active, "inactive_reason": F.when(~F.coalesce(F.col(good), F.lit(False)), "session_excluded").when(cohort == "confirmation", "held_out").otherwise("")}).drop("members")


def division_coverage(presence: DataFrame, sessions: DataFrame, divisions: DataFrame, *, source: str, subject: str, division: str, minimum: int) -> tuple[DataFrame, DataFrame]:
    """(by subject, gates): a subject by division grid with sessions present of those selected, and per division whether it is represented and varies."""
    selected = sessions.where("is_good_session").select(source, subject)
    grid = selected.groupBy(subject).agg(F.count("*").alias("n_selected")).join(F.broadcast(divisions.select(division)))
    found = presence.join(selected, [source]).groupBy(subject, division).agg(F.countDistinct(source).alias("n_present"))
    by = grid.join(found, [subject, division], "left").fillna(0, ["n_present"])
    gates = by.groupBy(division).agg(F.count_if(F.expr("n_present > 0")).alias("n_subjects"), (F.var_samp(F.col("n_present") / F.col("n_selected")) > 0).alias("varies"))
    return by, gates.withColumn("is_eligible", (F.col("n_subjects") >= minimum) & F.coalesce("varies", F.lit(False)))
