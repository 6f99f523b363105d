"""Sessions: behaviour by block, quality flags, attrition, audits, units and regions, and equal-weight means over sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import is_finite, loglinear_dprime, reasons, reversible, wilson_interval, window_count, z_of

PHASES = ("engaged_1", "no_reward", "late_no_reward", "engaged_2", "late_engaged_2")


@dataclass(frozen=True)
class SessionThresholds:
    min_go: int = 10
    min_catch: int = 5
    min_engaged_rate: float = 0.5
    min_dprime: float = 1.0
    max_late_no_reward_rate: float = 0.2
    min_drop: float = 0.3


def with_condition(trials: DataFrame) -> DataFrame:
    """Trials that are go or catch but not both, neither aborted nor auto-rewarded, with condition."""
    ok = (F.col("go") != F.col("catch")) & ~F.col("aborted") & ~F.col("auto_rewarded")
    return trials.where(ok).withColumn("condition", F.when(F.col("go"), "go").otherwise("catch"))


def eligible_event_trials(trials: DataFrame, *, event: str = "change_time", response: str = "response", latency: str = "latency", window: tuple[float, float] = (0.15, 0.75)) -> DataFrame:
    """Go and catch trials with a valid event and response; a latency outside of the window becomes null."""
    return with_condition(trials).where(is_finite(event) & F.col(response).isNotNull()).withColumn(latency, F.when((F.col(latency) > window[0]) & (F.col(latency) <= window[1]), F.col(latency)))


def session_behavior(trials: DataFrame, *, source: str = "source", subject: str = "subject", event: str = "change_time", response: str = "response", block: str = "reward_block", tail: float = 600.0, late: float = 600.0, confidence: float = 0.95) -> DataFrame:
    """One row per session, by one conditional aggregate: go and catch counts and responses by phase, rates, Wilson intervals, d' and contrasts.

    late_no_reward is the last tail seconds of the middle block; engaged_2 is cut at late seconds before its end, and
    late_engaged_2 is what was cut. Membership goes by the event's time.
    """
    # the window shares the exchange by session that labels blocks
    session = Window.partitionBy(source)
    ended = trials.withColumns({f"_end_{b}": F.max(F.when(F.col(block) == b, F.col("stop_time"))).over(session) for b in ("no_reward", "engaged_2")})
    own = with_condition(ended).where(is_finite(event) & F.col(response).isNotNull())
    t = F.col(event)
    phase = {
        "engaged_1": F.col(block) == "engaged_1", "no_reward": F.col(block) == "no_reward", "late_no_reward": (F.col(block) == "no_reward") & (t >= F.col("_end_no_reward") - tail),
        "engaged_2": (F.col(block) == "engaged_2") & (t < F.col("_end_engaged_2") - late), "late_engaged_2": (F.col(block) == "engaged_2") & (t >= F.col("_end_engaged_2") - late),
    }
    sums = []
    for p, inside in phase.items():
        for c in ("go", "catch"):
            here = inside & (F.col("condition") == c)
            sums += [F.count_if(here).alias(f"{p}_n_{c}"), F.count_if(here & F.col(response)).alias(f"{p}_{c}_responses")]
    out = own.groupBy(source, subject).agg(*sums)
    # each formula is bound once, over an array of phases, so that the plan and its generated code stay small
    z = z_of(confidence)
    pairs = F.array(*[F.struct(F.col(f"{p}_{c}_responses").alias("k"), F.col(f"{p}_n_{c}").alias("n")) for p in PHASES for c in ("go", "catch")])

    def rates(x: Column) -> Column:
        low, high = wilson_interval(x["k"], x["n"], z)
        return F.struct(F.when(x["n"] > 0, x["k"] / x["n"]).alias("rate"), low.alias("low"), high.alias("high"))

    fours = F.array(*[F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("go_responses", "n_go", "catch_responses", "n_catch")]) for p in PHASES])
    out = out.withColumns({"_r": F.transform(pairs, rates), "_d": F.transform(fours, lambda x: loglinear_dprime(*[x[c] for c in ("go_responses", "n_go", "catch_responses", "n_catch")]))})
    of = {f"{p}_{c}_{name}": F.col("_r")[2 * i + j][name] for i, p in enumerate(PHASES) for j, c in enumerate(("go", "catch")) for name in ("rate", "low", "high")}
    out = out.withColumns({**of, **{f"{p}_dprime": F.col("_d")[i] for i, p in enumerate(PHASES)}}).drop("_r", "_d")
    return out.withColumns({
        "suppression_drop": F.least("engaged_1_go_rate", "engaged_2_go_rate") - F.col("late_no_reward_go_rate"),
        "go_contrast": reversible(*[F.col(f"{p}_go_rate") for p in ("engaged_1", "late_no_reward", "engaged_2")]),
        "catch_contrast": reversible(*[F.col(f"{p}_catch_rate") for p in ("engaged_1", "late_no_reward", "engaged_2")]),
    }).withColumn("specificity_contrast", F.col("go_contrast") - F.col("catch_contrast"))


def _criteria(t: SessionThresholds) -> list[tuple[str, Column, str]]:
    """(name, condition, kind of failure when it is false)."""
    least = lambda name, cols, n: (name, *[F.least(*[F.coalesce(F.col(c), F.lit(0)) for c in cols]) >= n], "below_threshold")
    return [
        ("structure", F.col("is_valid_structure"), "fails"),
        least("go_count", ["engaged_1_n_go", "late_no_reward_n_go", "engaged_2_n_go"], t.min_go),
        least("catch_count", ["engaged_1_n_catch", "late_no_reward_n_catch", "engaged_2_n_catch"], t.min_catch),
        ("engaged_rate", F.when(F.col("engaged_1_go_rate").isNotNull() & F.col("engaged_2_go_rate").isNotNull(), F.least("engaged_1_go_rate", "engaged_2_go_rate") >= t.min_engaged_rate), "below_threshold"),
        ("dprime", F.when(F.col("engaged_1_dprime").isNotNull() & F.col("engaged_2_dprime").isNotNull(), F.least("engaged_1_dprime", "engaged_2_dprime") >= t.min_dprime), "below_threshold"),
        ("late_rate", F.col("late_no_reward_go_rate") <= t.max_late_no_reward_rate, "above_threshold"),
        ("drop", F.when(F.col("engaged_1_go_rate").isNotNull() & F.col("engaged_2_go_rate").isNotNull(), F.col("suppression_drop") >= t.min_drop), "below_threshold"),
    ]


def good_session(t: SessionThresholds = SessionThresholds()) -> Column:
    """The conjunction of all criteria, null counted as false."""
    out = F.lit(True)
    for _, condition, _ in _criteria(t):
        out = out & F.coalesce(condition, F.lit(False))
    return out


def add_good_session(sessions: DataFrame, t: SessionThresholds = SessionThresholds()) -> DataFrame:
    """sessions with passes_<criterion>, is_good_session and the reasons of exclusion: what can't be evaluated apart from what fails."""
    named, flags = [], {}
    for name, condition, fails in _criteria(t):
        flags[f"passes_{name}"] = F.coalesce(condition, F.lit(False))
        named += [(f"{name}_unevaluable", condition.isNull()), (f"{name}_{fails}", ~condition)]
    return sessions.withColumns({**flags, "is_good_session": good_session(t), "exclusion_reasons": reasons(*named)})


def session_blocks(sessions: DataFrame, *, source: str = "source", subject: str = "subject") -> DataFrame:
    """Long: a row for each session and phase, with its order and whether it is primary."""
    primary = ("engaged_1", "late_no_reward", "engaged_2")
    rows = [F.struct(F.lit(p).alias("phase"), F.lit(i).alias("phase_order"), F.lit(p in primary).alias("is_primary"), F.col(f"{p}_go_rate").alias("go_rate"), F.col(f"{p}_catch_rate").alias("catch_rate"), F.col(f"{p}_dprime").alias("dprime")) for i, p in enumerate((*primary, "late_engaged_2"))]
    return sessions.select(source, subject, "is_good_session", F.explode(F.array(*rows)).alias("r")).select(source, subject, "is_good_session", "r.*")


def equal_weight_means(rows: DataFrame, values: list[str], *, by: list[str], unit: str = "source") -> DataFrame:
    """Means over units that count alike: first within each unit, then over units; n_<value> units contribute, null and NaN don't.

    by holds the keys of the result. A unit's rows are averaged before, so its number of rows has no weight.
    """
    inner = rows.groupBy(*by, unit).agg(*[F.avg(F.when(is_finite(v), F.col(v))).alias(v) for v in values])
    return inner.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values], *[F.count(v).alias(f"n_{v}") for v in values], F.count("*").alias("n_units"))


def subject_blocks(blocks: DataFrame, *, source: str = "source", subject: str = "subject", values: tuple[str, ...] = ("go_rate", "catch_rate", "dprime")) -> DataFrame:
    """Subject by phase equal-session means, for all and for good sessions. Every session has all phases, so the grid is complete."""
    cohorts = F.when(F.col("is_good_session"), F.array(F.lit("all"), F.lit("good"))).otherwise(F.array(F.lit("all")))
    rows = blocks.withColumn("cohort", F.explode(cohorts))
    return equal_weight_means(rows, list(values), by=["cohort", subject, "phase", "phase_order", "is_primary"], unit=source)


def attrition(sessions: DataFrame, steps: list[tuple[str, Column]], *, subject: str = "subject") -> DataFrame:
    """A funnel of conditions that add up: per step, sessions and subjects left, sessions removed, and the fraction of all."""
    held, sums, rows = F.lit(True), [], []
    for i, (name, condition) in enumerate([("all", F.lit(True)), *steps]):
        held = held & F.coalesce(condition, F.lit(False))
        sums += [F.count_if(held).alias(f"s{i}"), F.countDistinct(F.when(held, F.col(subject))).alias(f"m{i}")]
        rows.append(F.struct(F.lit(i).alias("step_order"), F.lit(name).alias("step"), F.col(f"s{i}").alias("n_sessions"), F.col(f"m{i}").alias("n_subjects"), (F.col(f"s{max(0, i - 1)}") - F.col(f"s{i}")).alias("n_removed"), F.when(F.col("s0") > 0, F.col(f"s{i}") / F.col("s0")).alias("fraction")))
    return sessions.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def label_agreement(trials: DataFrame, own: str, author: str, *, by: list[str]) -> DataFrame:
    """Per group: missing labels, comparisons, disagreements and the rate of agreement."""
    both = F.col(own).isNotNull() & F.col(author).isNotNull()
    out = trials.groupBy(*by).agg(F.count("*").alias("n_trials"), F.count_if(F.col(author).isNull()).alias("n_missing_author"), F.count_if(F.col(own).isNull()).alias("n_missing_own"), F.count_if(both).alias("n_compared"), F.count_if(both & (F.col(own) != F.col(author))).alias("n_disagreed"))
    return out.withColumn("agreement", F.when(F.col("n_compared") > 0, 1 - F.col("n_disagreed") / F.col("n_compared")))


def lick_audit(trials: DataFrame, *, source: str = "source", block: str = "reward_block", status: str = "lick.status") -> DataFrame:
    """Sums of lick counts by session and block and by session, with scope, from grouping sets in one pass."""
    own = trials.select(source, block, F.col(status).alias("_status"), *[F.col(f"lick.{c}").alias(c) for c in ("n_raw", "n_unique", "n_duplicates")])
    sums = [F.count("*").alias("n_trials"), F.count_if(F.col("_status") == "pass").alias("n_pass"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_raw", "n_unique", "n_duplicates")], F.grouping(block).alias("_g")]
    out = own.groupingSets([[F.col(source), F.col(block)], [F.col(source)]], F.col(source), F.col(block)).agg(*sums)
    return out.withColumns({"scope": F.when(F.col("_g") == 1, "session").otherwise("block"), "is_consistent": F.col("n_raw") == F.col("n_unique") + F.col("n_duplicates"), "status": F.when(F.col("n_pass") == F.col("n_trials"), "pass").otherwise("incomplete")}).drop("_g")


def flag_audit(trials: DataFrame, inventory: DataFrame, *, source: str = "source") -> DataFrame:
    """Per session of the inventory: how the flag was found, conflicts, and status."""
    out = trials.groupBy(source).agg(F.count("*").alias("n_trials"), *[F.count_if(F.col("flag_source") == s).alias(f"n_{s}") for s in ("primary", "companion", "missing")], F.count_if("flag_conflict").alias("n_conflicts"))
    joined = inventory.select(source).join(out, source, "left").fillna(0)
    return joined.withColumn("status", F.when(F.col("n_trials") == 0, "no_trials").when(F.col("n_conflicts") > 0, "conflict").when(F.col("n_missing") > 0, "missing_flags").otherwise("pass"))


def support_distribution(windows: DataFrame, *, by: list[str], value: str = "n_trials") -> DataFrame:
    """Count, extremes, linear quantiles and total of a value per group."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    return windows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), q.alias("_q"), F.max(value).alias("most"), F.sum(value).alias("total")).select(*by, "n", "least", *[F.col("_q")[i].alias(c) for i, c in enumerate(("p05", "p25", "p50", "p75", "p95"))], "most", "total")


def criterion_counts(sessions: DataFrame, *, subject: str = "subject") -> DataFrame:
    """For each passes_<criterion>: sessions that pass, subjects with any and with all sessions passing."""
    names = [c for c in sessions.columns if c.startswith("passes_")]
    long = sessions.select(subject, F.explode(F.array(*[F.struct(F.lit(c.removeprefix("passes_")).alias("criterion"), F.col(c).alias("ok")) for c in names])).alias("r")).select(subject, "r.*")
    by = long.groupBy("criterion", subject).agg(F.count_if("ok").alias("n"), F.bool_or("ok").alias("some"), F.bool_and("ok").alias("every"))
    return by.groupBy("criterion").agg(F.sum("n").alias("n_sessions"), F.count_if("some").alias("n_subjects_any"), F.count_if("every").alias("n_subjects_all"))


def rate_stability(units: DataFrame, windows: DataFrame, *, source: str = "source", spikes: str = "spike_times", min_ratio: float = 0.5) -> DataFrame:
    """Units with spikes and rates in both engaged windows, the ratio of the smaller to the larger rate, and status."""
    joined = units.join(windows, source, "left")
    out = joined
    for k in ("e1", "e2"):
        n = window_count(spikes, F.col(f"{k}_start"), F.col(f"{k}_stop"))
        out = out.withColumn(f"{k}_spikes", F.when(F.col("status") == "pass", n)).withColumn(f"{k}_rate", F.col(f"{k}_spikes") / F.nullif(F.col(f"{k}_stop") - F.col(f"{k}_start"), F.lit(0.0)))
    ratio = F.least("e1_rate", "e2_rate") / F.nullif(F.greatest("e1_rate", "e2_rate"), F.lit(0.0))
    out = out.withColumn("rate_ratio", ratio)
    return out.withColumns({"stability": F.when(F.col("status").isNull() | (F.col("status") != "pass"), "no_windows").when(F.col("rate_ratio").isNull(), "silent").when(F.col("rate_ratio") < min_ratio, "unstable").otherwise("stable"), "is_consistent": F.coalesce(F.col("rate_ratio") >= min_ratio, F.lit(False))}).drop(spikes)


def unit_anatomy(units: DataFrame, labels: DataFrame, electrodes: DataFrame, ontology: DataFrame, *, source: str = "source", unit: str = "unit") -> DataFrame:
    """Units with label (1:1), electrode (m:1) and division (m:1), and an ordered inclusion status. A label of white matter or none has no region."""
    outside = ("root", "fiber tracts", "VS", "unknown", "")
    label = F.trim("label")
    joined = units.join(labels, [source, unit], "left").join(electrodes, [source, "peak_channel"], "left").join(F.broadcast(ontology), F.trim(F.col("label")) == F.col("acronym"), "left")
    region = F.when(label.isNotNull() & ~label.isin(*outside), label)
    status = F.when(F.col("label").isNull(), "no_label").when(region.isNull(), "outside_regions").when(F.col("x").isNull(), "no_electrode").when(F.col("division").isNull(), "unmapped").otherwise("included")
    return joined.withColumns({"region": region, "anatomy_status": status}).drop("acronym")


def coverage(units: DataFrame, *, by: list[str], distinct: dict[str, str]) -> DataFrame:
    """Distinct counts by group; null groups are named [missing]."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("[missing]")).alias(c) for c in by]
    return units.groupBy(*named).agg(*[F.countDistinct(c).alias(n) for n, c in distinct.items()], F.count("*").alias("n_units"))


def complete_counts(rows: DataFrame, grid: DataFrame, keys: list[str], **counts: Column) -> DataFrame:
    """Conditional counts over a complete grid of keys, 0 where there's no row."""
    found = rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return grid.join(found, keys, "left").fillna(0, list(counts))


def block_contrasts(rows: DataFrame, values: list[str], *, by: list[str], block: str = "reward_block", minimum: int = 5, count: str = "n_trials") -> DataFrame:
    """Per group and value: the three block values and their reversible contrast, if each block has enough trials."""
    of = lambda b, v: F.max(F.when(F.col(block) == b, F.col(v)))
    blocks = ("engaged_1", "no_reward", "engaged_2")
    wide = rows.groupBy(*by).agg(*[of(b, v).alias(f"{v}_{b}") for v in values for b in blocks], *[F.coalesce(of(b, count), F.lit(0)).alias(f"n_{b}") for b in blocks])
    enough = F.least(*[F.col(f"n_{b}") for b in blocks]) >= minimum
    long = wide.select(*by, enough.alias("has_support"), F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), *[F.col(f"{v}_{b}").alias(b) for b in blocks]) for v in values])).alias("r")).select(*by, "has_support", "r.*")
    contrast = reversible(F.col("engaged_1"), F.col("no_reward"), F.col("engaged_2"))
    return long.withColumns({"contrast": F.when(F.col("has_support"), contrast), "status": F.when(~F.col("has_support"), "too_few_trials").when(contrast.isNull(), "missing_block").otherwise("pass")})


def probe_conditions(trials: DataFrame, *, image: str = "change_image", contrast_image: str = "im115", novel: str = "is_designated_novel") -> DataFrame:
    """Each trial as up to two probe rows: contrast (one image, reduced or full) and novelty (full contrast only)."""
    from ..functions import image_contrast, image_identity

    c = image_contrast(image)
    first = F.when(image_identity(image) == contrast_image, F.struct(F.lit("contrast").alias("probe"), F.when(c < 1, "reduced").otherwise("full").alias("probe_condition")))
    second = F.when(c == 1, F.struct(F.lit("novelty").alias("probe"), F.when(F.col(novel), "novel").otherwise("familiar").alias("probe_condition")))
    return trials.select("*", F.explode(F.array_compact(F.array(first, second))).alias("p")).select(*trials.columns, "p.*")


def condition_difference(rows: DataFrame, *, by: list[str], condition: str, test: str, reference: str, value: str, name: str = "difference") -> DataFrame:
    """Test less reference per group, of groups that have both."""
    of = lambda c: F.max(F.when(F.col(condition) == c, F.col(value)))
    return rows.groupBy(*by).agg((of(test) - of(reference)).alias(name)).where(F.col(name).isNotNull())


def dominant_labels(rows: DataFrame, *, by: list[str], label: str) -> DataFrame:
    """The most frequent label per group, ties by name."""
    return rows.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by(F.struct(label, "n"), F.struct("n", F.col(label))).alias("r")).select(*by, f"r.{label}", "r.n")
