"""Registered queries of whole studies: scores around transitions, response classes and profiles, covariates, frozen axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axis as A
from ..operators import blocks as B
from ..operators import joins as J
from ..operators import network as N
from ..operators import responses as P
from ..operators import scores as SC
from .registry import query, r
from .views import DAY, TRIALS, labelled, spikes, table

# --- scores around transitions ---------------------------------------------------------------

_ANCHORS = f"""{TRIALS},
bounds AS (SELECT source, subject, {', '.join(f"min(start_time) FILTER (reward_block = '{b}') AS lo{i}, max(stop_time) FILTER (reward_block = '{b}') AS hi{i}" for i, b in enumerate(('engaged_1', 'no_reward', 'engaged_2')))} FROM labelled GROUP BY ALL),
marks AS ({' UNION ALL '.join(f"SELECT source, subject, '{name}' AS transition, {sign} AS direction, '{anchor}' AS anchor, CASE WHEN lo{i} IS NOT NULL AND lo{i + 1} IS NOT NULL THEN {t} END AS t0, '{before}' AS b0, '{after}' AS b1 FROM bounds" for i, name, sign, pre, post in ((0, 'withdrawal', -1, 'engaged_1', 'no_reward'), (1, 'restoration', 1, 'no_reward', 'engaged_2')) for anchor, t, before, after in (('real', f'lo{i + 1}', pre, post), ('pseudo', f'(lo{i} + hi{i}) / 2', pre, pre)))}),
near AS (SELECT m.*, change_time - t0 AS rel, sqrt(value) / 10 AS s FROM labelled l JOIN marks m USING (source) WHERE event_type <> 'error' AND value IS NOT NULL AND reward_block = CASE WHEN change_time - t0 < 0 THEN b0 ELSE b1 END)"""
_STEPS = f"""sides AS (SELECT source, transition, anchor, count(*) FILTER (rel < 0) AS n_pre, count(*) FILTER (rel >= 0) AS n_post, avg(s) FILTER (rel < 0) AS pre_mean, avg(s) FILTER (rel >= 0) AS post_mean FROM near WHERE rel >= -{5 * DAY} AND rel < {5 * DAY} GROUP BY ALL),
steps AS (SELECT source, subject, transition, anchor, coalesce(n_pre, 0) AS n_pre, coalesce(n_post, 0) AS n_post, pre_mean, post_mean, CASE WHEN least(coalesce(n_pre, 0), coalesce(n_post, 0)) >= 5 THEN direction * (post_mean - pre_mean) END AS signed_step,
  CASE WHEN t0 IS NULL THEN 'invalid_boundary' WHEN least(coalesce(n_pre, 0), coalesce(n_post, 0)) >= 5 THEN 'pass' ELSE 'insufficient_trials' END AS status FROM marks LEFT JOIN sides USING (source, transition, anchor))"""


def score_tables(spark: SparkSession, sf_dir: str) -> SC.ScoreTables:
    t = labelled(spark, sf_dir)
    scored = t.where("event_type <> 'error'").withColumn("score", F.sqrt("value") / 10)
    return SC.transition_scores(scored, B.transition_boundaries(t), SC.ScoreConfig(5 * DAY, DAY, 5 * DAY, 5))


@query(f"""WITH {_ANCHORS}, grid AS (SELECT *, unnest(range(-5, 5)) AS bin FROM marks), f AS (SELECT source, transition, anchor, CAST(floor(rel / {DAY}) AS BIGINT) AS bin, count(*) AS n, avg(s) AS m FROM near GROUP BY ALL)
 SELECT source, subject, transition, anchor, CAST(bin AS INT) AS bin, bin * {DAY} AS bin_start, CASE WHEN bin < 0 THEN b0 ELSE b1 END AS expected_block, coalesce(n, 0) AS n_trials, round(m, 6) AS mean_score, CASE WHEN t0 IS NULL THEN 'invalid_boundary' WHEN n IS NULL THEN 'no_trials' ELSE 'pass' END AS status FROM grid LEFT JOIN f USING (source, transition, anchor, bin)""")
def score_trajectories(spark, sf_dir):
    """Scores by day around real and pseudo boundaries; trials of the wrong block don't count."""
    return score_tables(spark, sf_dir).session_trajectories.select("source", "subject", "transition", "anchor", "bin", "bin_start", "expected_block", "n_trials", *r("mean_score"), "status")


@query(f"WITH {_ANCHORS}, {_STEPS} SELECT source, subject, transition, anchor, n_pre, n_post, round(pre_mean, 6) AS pre_mean, round(post_mean, 6) AS post_mean, round(signed_step, 6) AS signed_step, status FROM steps")
def score_steps(spark, sf_dir):
    return score_tables(spark, sf_dir).session_steps.select("source", "subject", "transition", "anchor", "n_pre", "n_post", *r("pre_mean", "post_mean", "signed_step"), "status")


@query(f"""WITH {_ANCHORS}, {_STEPS}, c AS (SELECT a.subject, a.transition, a.signed_step - b.signed_step AS d FROM steps a JOIN steps b ON a.source = b.source AND a.transition = b.transition AND a.anchor = 'real' AND b.anchor = 'pseudo')
 SELECT subject, transition, count(*) AS n_sessions, round(avg(d), 6) AS real_minus_pseudo FROM c WHERE d IS NOT NULL GROUP BY 1, 2""")
def score_contrasts(spark, sf_dir):
    return score_tables(spark, sf_dir).subject_contrasts.select("subject", "transition", "n_sessions", *r("real_minus_pseudo"))


# --- classes of responses and profiles ---------------------------------------------------------


def unit_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trials of units (suppliers) of ten sessions."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("source"), F.col("l_suppkey").alias("unit"), (F.col("l_linenumber") % 2).alias("half"), (F.col("l_quantity") - 25.5).alias("early"), ((F.col("l_discount") - 0.05) * 500).alias("late"),
        ((F.col("l_tax") - 0.04) * 600).alias("action"), (F.col("l_returnflag") == "R").alias("responded"),
    )


_HALF = lambda h: f"""SELECT source, unit, {h} AS half, avg(early) FILTER (half = {h}) AS e, avg(late) FILTER (half = {h}) AS l, avg(action) FILTER (half = {h} AND responded) AS a FROM ut GROUP BY 1, 2"""
_CLASSES = f"""ut AS (SELECT l_suppkey % 10 AS source, l_suppkey AS unit, l_linenumber % 2 AS half, l_quantity - 25.5 AS early, (l_discount - 0.05) * 500 AS late, (l_tax - 0.04) * 600 AS action, l_returnflag = 'R' AS responded FROM lineitem),
halves AS ({_HALF(0)} UNION ALL {_HALF(1)}),
named AS (SELECT source, unit, half, [abs(e), abs(l), abs(a)] AS z, CASE WHEN e IS NOT NULL AND l IS NOT NULL AND a IS NOT NULL THEN list_position(z, list_max(z)) END AS k, sign([e, l, a][k]) AS sg, CASE WHEN k IS NOT NULL THEN (list_reverse_sort(z)[1] - list_reverse_sort(z)[2]) / greatest(list_max(z), 1e-12) END AS mg FROM halves),
classed AS (SELECT source, unit, ['early_sensory', 'late_prelick', 'action_related'][p.k] AS half_0_class, ['early_sensory', 'late_prelick', 'action_related'][q.k] AS half_1_class, coalesce(p.k = q.k AND p.sg = q.sg AND p.sg <> 0, false) AS is_stable,
  CASE WHEN is_stable THEN half_0_class ELSE 'continuous_only' END AS response_class, CASE WHEN is_stable THEN p.sg END AS sign, CASE WHEN p.mg IS NOT NULL AND q.mg IS NOT NULL THEN least(p.mg, q.mg) END AS margin FROM (SELECT * FROM named WHERE half = 0) p JOIN (SELECT * FROM named WHERE half = 1) q USING (source, unit))"""


@query(f"WITH {_CLASSES} SELECT source, unit, half_0_class, half_1_class, is_stable, response_class, CAST(sign AS DOUBLE) AS sign, round(margin, 6) AS margin FROM classed")
def response_archetypes(spark, sf_dir):
    return P.response_classes(unit_trials(spark, sf_dir), by=["source", "unit"]).select("source", "unit", "half_0_class", "half_1_class", "is_stable", "response_class", "sign", *r("margin"))


@query(f"""WITH {_CLASSES} SELECT unit % 7 AS subject, count(DISTINCT source) AS n_sessions, count(*) AS n_units, count(*) FILTER (is_stable) AS n_stable_units, {', '.join(f"count(*) FILTER (response_class = '{c}') AS n_{c}" for c in P.CLASSES)}, round(avg(margin), 6) AS mean_margin, round(count(*) FILTER (is_stable) / count(*), 6) AS stable_fraction FROM classed GROUP BY 1""")
def response_class_stability(spark, sf_dir):
    units = P.response_classes(unit_trials(spark, sf_dir), by=["source", "unit"]).withColumn("subject", F.col("unit") % 7)
    out = P.class_stability(units, by=["subject"], session="source")
    return out.select("subject", "n_sessions", "n_units", "n_stable_units", *[f"n_{c}" for c in P.CLASSES], *r("mean_margin", "stable_fraction"))


_START, _WIDTH, _BINS = -2 * DAY, DAY / 2, 8


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by half days around every trial, an array for each."""
    return J.histograms_around(spikes(spark, sf_dir), labelled(spark, sf_dir), by=["source"], point="t", event="change_time", start=_START, width=_WIDTH, bins=_BINS, unit=["unit"], event_key=["id", "reward_block", "value"])


_BINNED = f"""{TRIALS}, types AS (SELECT DISTINCT source, event_type AS unit FROM trials), cells AS (SELECT l.source, l.id, l.reward_block, l.value, l.change_time, u.unit, k AS bin FROM labelled l JOIN types u USING (source) CROSS JOIN (SELECT unnest(range({_BINS})) AS k)),
hits AS (SELECT l.id, p.event_type AS unit, CAST(floor((p.start_time - l.change_time - ({_START})) / {_WIDTH}) AS BIGINT) AS bin, count(*) AS n FROM labelled l JOIN trials p ON p.source = l.source AND p.start_time >= l.change_time + {_START} AND p.start_time < l.change_time + {_START + _WIDTH * _BINS} GROUP BY ALL),
binned AS (SELECT c.*, coalesce(n, 0) AS n, {_START} + (bin + 0.5) * {_WIDTH} AS centre FROM cells c LEFT JOIN hits h USING (id, unit, bin))"""


@query(f"""WITH {_BINNED}, one AS (SELECT source, id, unit, sqrt(sum(n) FILTER (centre >= 0) + 0.375) / sqrt(count(*) FILTER (centre >= 0) * {_WIDTH}) - sqrt(sum(n) FILTER (centre < 0) + 0.375) / sqrt(count(*) FILTER (centre < 0) * {_WIDTH}) AS a,
  CASE WHEN count(*) FILTER (centre >= 0 AND centre + {_WIDTH / 2} <= value * {DAY / 100} + 1e-9) > 0 THEN sqrt(sum(n) FILTER (centre >= 0 AND centre + {_WIDTH / 2} <= value * {DAY / 100} + 1e-9) + 0.375) / sqrt(count(*) FILTER (centre >= 0 AND centre + {_WIDTH / 2} <= value * {DAY / 100} + 1e-9) * {_WIDTH}) - sqrt(sum(n) FILTER (centre < 0) + 0.375) / sqrt(count(*) FILTER (centre < 0) * {_WIDTH}) END AS b FROM binned GROUP BY ALL)
 SELECT source, unit, round(avg(a), 8) AS response, count(b) AS n_censored, round(avg(b), 8) AS censored_response FROM one GROUP BY 1, 2""".replace("GROUP BY ALL)\n SELECT source, unit", "GROUP BY source, id, unit, value)\n SELECT source, unit"))
def window_responses(spark, sf_dir):
    """Variance-stabilised responses, over the whole window and before each trial's own stop, averaged over trials."""
    windows = {"start": _START, "width": _WIDTH, "response": (0.0, 2 * DAY), "baseline": (-2 * DAY, 0.0)}
    whole, cut = (P.counts_response("counts", _BINS, stop=stop, **windows) for stop in (None, F.col("value") * (DAY / 100)))
    out = binned(spark, sf_dir).select("source", "unit", whole.alias("whole"), cut.alias("cut")).groupBy("source", "unit").agg(F.avg("whole").alias("response"), F.count("cut").alias("n_censored"), F.avg("cut").alias("censored_response"))
    return out.select("source", "unit", *r("response", "censored_response", digits=8), "n_censored")


@query(f"""WITH {_BINNED}, rates AS (SELECT source, unit, reward_block, bin, count(*) AS n_trials, avg(n) / {_WIDTH} AS m FROM binned GROUP BY ALL), evoked AS (SELECT *, (m - avg(m) FILTER (bin < 4) OVER (PARTITION BY source, unit, reward_block)) * CASE WHEN source % 2 = 0 THEN 1 ELSE -1 END AS e FROM rates),
 ses AS (SELECT source % 27 AS subject, CASE WHEN unit IN ('view', 'click') THEN 'early_sensory' ELSE 'late_action' END AS grp, reward_block, bin, source, avg(e) AS m, count(DISTINCT unit) AS n_units, max(n_trials) AS n_trials FROM evoked WHERE source % 3 <> 0 AND unit IN ('view', 'click', 'purchase') GROUP BY ALL)
 SELECT subject, grp AS response_group, reward_block, CAST(bin AS INT) AS bin, round(avg(m) * {DAY}, 6) AS mean_rate, count(DISTINCT source) AS n_sessions, CAST(sum(n_units) AS BIGINT) AS n_unit_sessions, CAST(sum(n_trials) AS BIGINT) AS n_trial_sessions FROM ses GROUP BY 1, 2, 3, 4""")
def response_profiles(spark, sf_dir):
    """Mean sign-aligned rates of groups of units around trials, per subject."""
    bins = binned(spark, sf_dir)
    group = F.when(F.col("unit").isin("view", "click"), "early_sensory").when(F.col("unit") == "purchase", "late_action")
    units = spikes(spark, sf_dir).select("source", "unit").distinct().select("source", "unit", (F.col("source") % 27).alias("subject"), F.when(F.col("source") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"), (F.col("source") % 3 != 0).alias("is_stable"), group.alias("response_group"))
    profiles = P.unit_profiles(bins, units, session="source", unit="unit", block="reward_block", start=_START, width=_WIDTH, baseline=(_START, 0.0), counts="counts", n_bins=_BINS)
    _, subjects = P.group_profiles(profiles, session="source", subject="subject", unit="unit", block="reward_block", group="response_group")
    return subjects.select("subject", "response_group", "reward_block", "bin", F.round(F.col("mean_rate") * DAY, 6).alias("mean_rate"), "n_sessions", "n_unit_sessions", "n_trial_sessions")


# --- covariates and frozen axes ------------------------------------------------------------------


@query(f"""WITH {TRIALS}, s AS (SELECT *, CASE WHEN response THEN value / 100 END AS lat, (change_time - (min(change_time) OVER w + max(change_time) OVER w) / 2) / greatest((max(change_time) OVER w - min(change_time) OVER w) / 2, 1.0) AS slow,
  list_sort(list(DISTINCT event_type) OVER w)[2:] AS others, coalesce(median(CASE WHEN response THEN value / 100 END) OVER w, 0.0) AS mid FROM trials WINDOW w AS (PARTITION BY source)),
 v AS (SELECT id, list_concat(list_concat([slow, slow * slow], list_transform(others, lambda x: CAST(x = event_type AS DOUBLE))), [CAST(coalesce(response, false) AS DOUBLE), coalesce(lat, mid), CAST(lat IS NULL AS DOUBLE)]) AS vs FROM s)
 SELECT id, CAST(unnest(range(len(vs))) AS INT) AS place, round(unnest(vs), 6) AS value FROM v""")
def trial_covariates(spark, sf_dir):
    """Covariates of every trial, one row each."""
    t = labelled(spark, sf_dir).withColumn("latency", F.when(F.col("response"), F.col("value") / 100))
    return N.trial_covariates(t, by=["source"], image="event_type", latency="latency").select("id", F.posexplode("nuisance").alias("place", "value")).select("id", "place", *r("value"))


@query("""SELECT l_suppkey AS source, l_orderkey AS event, round(any_value(s_nationkey) + sum(l_quantity * round(s_acctbal) * l_linenumber), 4) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 4 GROUP BY 1, 2""")
def frozen_axis_scores(spark, sf_dir):
    """Scores of orders by an axis per supplier that was fitted elsewhere."""
    features = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("unit"), F.col("l_quantity").alias("value"))
    s = table(spark, sf_dir, "supplier")
    weights = s.select(F.col("s_suppkey").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("unit"), (F.round("s_acctbal") * F.col("unit")).alias("value"))
    return A.axis_scores(features, weights, s.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").cast("double").alias("value"))).select("source", "event", *r("score", digits=4))
