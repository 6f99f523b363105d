"""The library's registered queries over the test tables, each with SQL for the oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import image_contrast, image_identity, inverse_normal_sql, lick_free, lick_response, normalized_category, recording_day, stabilized
from ..operators import axis as A
from ..operators import blocks as B
from ..operators import cohorts as C
from ..operators import expect as X
from ..operators import inference as I
from ..operators import joins as J
from ..operators import models as M
from ..operators import network as N
from ..operators import sessions as Z
from .registry import ORACLES, QUERIES, query, r  # noqa: F401
from .views import CONDITIONED, DAY, ESTIMATES, IMAGES, LICKS, TRIALS, UNITS, estimates, images, labelled, licks, parts_of, spike_arrays, spikes, table, trials, units

TAIL = 5 * DAY
CONFIG = B.BinConfig()


# --- sessions by block -------------------------------------------------------------------------

_PHASE_SQL = {
    "engaged_1": "reward_block = 'engaged_1'", "no_reward": "reward_block = 'no_reward'", "late_no_reward": f"reward_block = 'no_reward' AND change_time >= end_nr - {TAIL}",
    "engaged_2": f"reward_block = 'engaged_2' AND change_time < end_e2 - {TAIL}", "late_engaged_2": f"reward_block = 'engaged_2' AND change_time >= end_e2 - {TAIL}",
}


def _session_sql() -> str:
    counts = ", ".join(f"count(*) FILTER ({w} AND condition = '{c}') AS {p}_n_{c}, count(*) FILTER ({w} AND condition = '{c}' AND response) AS {p}_{c}_responses" for p, w in _PHASE_SQL.items() for c in ("go", "catch"))
    z = "1.959963984540054"
    rates, wilson, dprimes = [], [], []
    for p in _PHASE_SQL:
        for c in ("go", "catch"):
            n, k = f"{p}_n_{c}", f"{p}_{c}_responses"
            rates.append(f"CASE WHEN {n} > 0 THEN {k} / {n} END AS {p}_{c}_rate")
            mid = f"(({k} / {n}) + {z} * {z} / (2.0 * {n})) / (1 + {z} * {z} / {n})"
            half = f"{z} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n})"
            wilson += [f"CASE WHEN {n} > 0 THEN greatest(0.0, {mid} - {half}) END AS {p}_{c}_low", f"CASE WHEN {n} > 0 THEN least(1.0, {mid} + {half}) END AS {p}_{c}_high"]
        zh = inverse_normal_sql(f"(CAST({p}_go_responses + 0.5 AS DOUBLE) / ({p}_n_go + 1))")
        zf = inverse_normal_sql(f"(CAST({p}_catch_responses + 0.5 AS DOUBLE) / ({p}_n_catch + 1))")
        dprimes.append(f"CASE WHEN {p}_n_go > 0 AND {p}_n_catch > 0 THEN ({zh}) - ({zf}) END AS {p}_dprime")
    return f"""{TRIALS}, {CONDITIONED},
ends AS (SELECT source, max(CASE WHEN reward_block = 'no_reward' THEN stop_time END) AS end_nr, max(CASE WHEN reward_block = 'engaged_2' THEN stop_time END) AS end_e2 FROM labelled GROUP BY 1),
counted AS (SELECT source, subject, {counts} FROM cond JOIN ends USING (source) GROUP BY 1, 2),
rated AS (SELECT *, {', '.join(rates + wilson + dprimes)} FROM counted),
sess AS (SELECT *, CASE WHEN engaged_1_go_rate IS NULL THEN engaged_2_go_rate WHEN engaged_2_go_rate IS NULL THEN engaged_1_go_rate ELSE least(engaged_1_go_rate, engaged_2_go_rate) END - late_no_reward_go_rate AS suppression_drop,
  0.5 * engaged_1_go_rate - late_no_reward_go_rate + 0.5 * engaged_2_go_rate AS go_contrast, 0.5 * engaged_1_catch_rate - late_no_reward_catch_rate + 0.5 * engaged_2_catch_rate AS catch_contrast FROM rated)"""


SESS = _session_sql()


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.session_behavior(labelled(spark, sf_dir), tail=TAIL, late=TAIL)


@query(f"""WITH {SESS} SELECT subject, round(avg(engaged_1_go_rate), 6) AS engaged_1, round(avg(late_no_reward_go_rate), 6) AS no_reward, round(avg(engaged_2_go_rate), 6) AS engaged_2,
 round(avg(go_contrast), 6) AS contrast, count(go_contrast) AS n_sessions FROM sess GROUP BY 1""")
def subject_gating(spark, sf_dir):
    """Equal-session means of the response rates of the three blocks and their contrast, per subject."""
    means = Z.equal_weight_means(sessions(spark, sf_dir), ["engaged_1_go_rate", "late_no_reward_go_rate", "engaged_2_go_rate", "go_contrast"], by=["subject"])
    return means.select("subject", *[F.round(a, 6).alias(b) for a, b in (("engaged_1_go_rate", "engaged_1"), ("late_no_reward_go_rate", "no_reward"), ("engaged_2_go_rate", "engaged_2"), ("go_contrast", "contrast"))], F.col("n_go_contrast").alias("n_sessions"))


_CHOSEN = [f"{p}_{c}" for p in Z.PHASES for c in ("go_rate", "go_low", "go_high", "catch_rate", "dprime")] + ["suppression_drop", "go_contrast", "catch_contrast"]


@query(f"WITH {SESS} SELECT source, subject, {', '.join(f'{p}_n_go, {p}_n_catch, {p}_go_responses' for p in Z.PHASES)}, {', '.join(f'round({c}, 6) AS {c}' for c in _CHOSEN)}, round(go_contrast - catch_contrast, 6) AS specificity_contrast FROM sess")
def session_behavior(spark, sf_dir):
    return sessions(spark, sf_dir).select("source", "subject", *[c for p in Z.PHASES for c in (f"{p}_n_go", f"{p}_n_catch", f"{p}_go_responses")], *r(*_CHOSEN, "specificity_contrast"))


_STRUCT = """struc AS (SELECT source, count(*) AS n_trials, count(DISTINCT idx) AS n_indices, count(*) FILTER (stop_time <= start_time) AS n_nonpositive, count(*) FILTER (no_reward AND NOT coalesce(before, false)) AS n_runs, count(*) FILTER (start_time < prev) AS n_decreasing,
  count(*) FILTER (reward_block = 'engaged_1') AS n_engaged_1, count(*) FILTER (reward_block = 'no_reward') AS n_no_reward, count(*) FILTER (reward_block = 'engaged_2') AS n_engaged_2
  FROM (SELECT *, lag(no_reward) OVER (PARTITION BY source ORDER BY idx) AS before, lag(start_time) OVER (PARTITION BY source ORDER BY idx) AS prev FROM labelled) GROUP BY 1),
structure AS (SELECT *, n_indices = n_trials AND n_runs = 1 AND n_nonpositive = 0 AND n_decreasing = 0 AND n_engaged_1 > 0 AND n_no_reward > 0 AND n_engaged_2 > 0 AS is_valid_structure FROM struc)"""


@query(f"WITH {TRIALS}, {_STRUCT} SELECT * FROM structure")
def task_structure(spark, sf_dir):
    return B.task_structure(labelled(spark, sf_dir)).drop("n_missing_indices", "n_invalid_times", "n_unknown_flags")


THRESHOLDS = Z.SessionThresholds(min_go=3, min_catch=1, min_dprime=-0.5, max_late_no_reward_rate=0.9, min_drop=-0.2)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    structure = B.task_structure(labelled(spark, sf_dir)).select("source", "is_valid_structure")
    return Z.add_good_session(J.join_checked(sessions(spark, sf_dir), structure, ["source"], "left", "1:1"), THRESHOLDS)


_LEAST = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END"
FLAGGED = f"""{SESS}, {_STRUCT},
crit AS (SELECT s.*, is_valid_structure AS p_structure, least(engaged_1_n_go, late_no_reward_n_go, engaged_2_n_go) >= 3 AS p_go_count, least(engaged_1_n_catch, late_no_reward_n_catch, engaged_2_n_catch) >= 1 AS p_catch_count,
  {_LEAST('engaged_1_go_rate', 'engaged_2_go_rate')} >= 0.5 AS p_engaged_rate, {_LEAST('engaged_1_dprime', 'engaged_2_dprime')} >= -0.5 AS p_dprime, late_no_reward_go_rate <= 0.9 AS p_late_rate,
  CASE WHEN engaged_1_go_rate IS NOT NULL AND engaged_2_go_rate IS NOT NULL THEN suppression_drop >= -0.2 END AS p_drop FROM sess s LEFT JOIN structure USING (source)),
flags AS (SELECT *, coalesce(p_structure, false) AND coalesce(p_go_count, false) AND coalesce(p_catch_count, false) AND coalesce(p_engaged_rate, false) AND coalesce(p_dprime, false) AND coalesce(p_late_rate, false) AND coalesce(p_drop, false) AS is_good_session FROM crit)"""
_NAMES = ("structure", "go_count", "catch_count", "engaged_rate", "dprime", "late_rate", "drop")
_FAIL = {"structure": "fails", "late_rate": "above_threshold"}


@query(f"""WITH {FLAGGED} SELECT source, is_good_session, {', '.join(f'coalesce(p_{n}, false) AS passes_{n}' for n in _NAMES)},
 concat_ws(';', {', '.join(f"CASE WHEN p_{n} IS NULL THEN '{n}_unevaluable' END, CASE WHEN NOT p_{n} THEN '{n}_{_FAIL.get(n, 'below_threshold')}' END" for n in _NAMES)}) AS exclusion_reasons FROM flags""")
def session_quality(spark, sf_dir):
    return flagged(spark, sf_dir).select("source", "is_good_session", *[f"passes_{n}" for n in _NAMES], "exclusion_reasons")


@query(f"""WITH {FLAGGED}, c AS (SELECT *, p_structure AND true AS a1 FROM flags), k AS (SELECT count(*) AS s0, count(DISTINCT subject) AS m0, count(*) FILTER (p_structure) AS s1, count(DISTINCT CASE WHEN p_structure THEN subject END) AS m1,
 count(*) FILTER (p_structure AND p_go_count) AS s2, count(DISTINCT CASE WHEN p_structure AND p_go_count THEN subject END) AS m2, count(*) FILTER (p_structure AND p_go_count AND is_good_session) AS s3, count(DISTINCT CASE WHEN p_structure AND p_go_count AND is_good_session THEN subject END) AS m3 FROM flags)
 SELECT 0 AS step_order, 'all' AS step, s0 AS n_sessions, m0 AS n_subjects, 0 AS n_removed, CAST(1 AS DOUBLE) AS fraction FROM k UNION ALL SELECT 1, 'structure', s1, m1, s0 - s1, s1 / s0 FROM k UNION ALL SELECT 2, 'go_trials', s2, m2, s1 - s2, s2 / s0 FROM k UNION ALL SELECT 3, 'good', s3, m3, s2 - s3, s3 / s0 FROM k""")
def session_attrition(spark, sf_dir):
    return Z.attrition(flagged(spark, sf_dir), [("structure", F.col("passes_structure")), ("go_trials", F.col("passes_go_count")), ("good", F.col("is_good_session"))])


@query(f"""WITH {FLAGGED}, long AS ({' UNION ALL '.join(f"SELECT subject, '{n}' AS criterion, coalesce(p_{n}, false) AS ok FROM flags" for n in _NAMES)}),
 m AS (SELECT criterion, subject, count(*) FILTER (ok) AS n, bool_or(ok) AS some1, bool_and(ok) AS every1 FROM long GROUP BY 1, 2) SELECT criterion, sum(n) AS n_sessions, count(*) FILTER (some1) AS n_subjects_any, count(*) FILTER (every1) AS n_subjects_all FROM m GROUP BY 1""")
def criterion_counts(spark, sf_dir):
    return Z.criterion_counts(flagged(spark, sf_dir))


_BLOCK_LONG = " UNION ALL ".join(f"SELECT source, subject, is_good_session, '{p}' AS phase, {i} AS phase_order, {str(i < 3).lower()} AS is_primary, {p}_go_rate AS go_rate, {p}_catch_rate AS catch_rate, {p}_dprime AS dprime FROM flags" for i, p in enumerate(("engaged_1", "late_no_reward", "engaged_2", "late_engaged_2")))


@query(f"""WITH {FLAGGED}, long AS ({_BLOCK_LONG}), grid AS (SELECT DISTINCT 'all' AS cohort, l.subject, p.phase, p.phase_order, p.is_primary FROM long l CROSS JOIN (SELECT DISTINCT phase, phase_order, is_primary FROM long) p
 UNION ALL SELECT DISTINCT 'good', l.subject, p.phase, p.phase_order, p.is_primary FROM long l CROSS JOIN (SELECT DISTINCT phase, phase_order, is_primary FROM long) p WHERE l.is_good_session),
 m AS (SELECT 'all' AS cohort, subject, phase, avg(go_rate) AS g, avg(catch_rate) AS c, count(go_rate) AS n FROM long GROUP BY 2, 3 UNION ALL SELECT 'good', subject, phase, avg(go_rate), avg(catch_rate), count(go_rate) FROM long WHERE is_good_session GROUP BY 2, 3)
 SELECT cohort, subject, phase, phase_order, is_primary, round(g, 6) AS go_rate, round(c, 6) AS catch_rate, n AS n_go_rate FROM grid LEFT JOIN m USING (cohort, subject, phase)""")
def subject_blocks(spark, sf_dir):
    out = Z.subject_blocks(Z.session_blocks(flagged(spark, sf_dir)))
    return out.select("cohort", "subject", "phase", "phase_order", "is_primary", *r("go_rate", "catch_rate"), "n_go_rate")


@query(f"""WITH {TRIALS} SELECT source, reward_block, min(start_time) AS block_start, max(stop_time) AS block_stop, round(max(stop_time) - min(start_time), 3) AS duration, round(min(start_time) - any_value(f), 3) AS "offset", min(idx) AS first_index, max(idx) AS last_index, count(*) AS n_trials
 FROM (SELECT *, min(start_time) OVER (PARTITION BY source) AS f FROM labelled) GROUP BY 1, 2""")
def block_timing(spark, sf_dir):
    return B.block_timing(labelled(spark, sf_dir)).withColumns({"duration": F.round("duration", 3), "offset": F.round("offset", 3)})


@query(f"""WITH {TRIALS}, w AS (SELECT *, start_time < lag(start_time) OVER (PARTITION BY source ORDER BY idx) AS back, count(*) OVER (PARTITION BY source, start_time) > 1 AS same FROM labelled)
 SELECT source, count(*) AS n_rows, count(*) FILTER (stop_time <= start_time) AS n_nonpositive, count(*) FILTER (back) AS n_decreasing, count(*) FILTER (same) AS n_repeated_starts, min(start_time) AS first_start, max(stop_time) AS last_stop,
 count(*) FILTER (stop_time <= start_time) + count(*) FILTER (back) + count(*) FILTER (same) = 0 AS passes FROM w GROUP BY 1""")
def interval_clock(spark, sf_dir):
    return B.interval_clock(labelled(spark, sf_dir), source="source", index="idx", start="start_time", stop="stop_time", event="change_time").drop("n_invalid", "n_events_outside")


# --- responses from arrays of event times --------------------------------------------------------

_RESPONSE = f"list_filter(list_distinct(lick_times), lambda x: x - lick_event > 0.15 AND x - lick_event <= 0.75)"


@query(f"""WITH {TRIALS}, {LICKS} SELECT id, 'pass' AS status, len({_RESPONSE}) > 0 AS response, round(list_min({_RESPONSE}) - lick_event, 6) AS latency, len(lick_times) AS n_raw, len(list_distinct(lick_times)) AS n_unique, len(lick_times) - len(list_distinct(lick_times)) AS n_duplicates FROM licks""")
def lick_responses(spark, sf_dir):
    """Response and latency of every trial from its array of times."""
    return licks(spark, sf_dir).select("id", lick_response("lick_event", "lick_times").alias("l")).select("id", "l.status", "l.response", F.round("l.latency", 6).alias("latency"), "l.n_raw", "l.n_unique", "l.n_duplicates")


@query(f"""WITH {TRIALS}, {LICKS}, c AS (SELECT source, reward_block, len(lick_times) AS a, len(list_distinct(lick_times)) AS b FROM licks)
 SELECT source, reward_block, 'block' AS scope, count(*) AS n_trials, sum(a) AS n_raw, sum(b) AS n_unique, sum(a - b) AS n_duplicates FROM c GROUP BY 1, 2 UNION ALL SELECT source, NULL, 'session', count(*), sum(a), sum(b), sum(a - b) FROM c GROUP BY 1""")
def lick_audit(spark, sf_dir):
    own = licks(spark, sf_dir).withColumn("lick", lick_response("lick_event", "lick_times"))
    return Z.lick_audit(own).select("source", "reward_block", "scope", "n_trials", "n_raw", "n_unique", "n_duplicates")


@query(f"""WITH {TRIALS}, {LICKS} SELECT reward_block, count(*) AS n_trials, count(*) FILTER (len(list_filter(lick_times, lambda x: x BETWEEN lick_event - 0.05 AND lick_event + 0.09)) = 0) AS n_narrow, count(*) FILTER (len(list_filter(lick_times, lambda x: x >= lick_event - 0.15 AND x <= lick_event + 0.3)) = 0) AS n_wide FROM licks GROUP BY 1""")
def lick_free_trials(spark, sf_dir):
    own = licks(spark, sf_dir)
    return own.groupBy("reward_block").agg(F.count("*").alias("n_trials"), F.count_if(lick_free("lick_times", "lick_event", 0.05, 0.09)).alias("n_narrow"), F.count_if(lick_free("lick_times", "lick_event", 0.15, 0.3, 0.0)).alias("n_wide"))


_AGREE = "SELECT {k} count(*) AS n_trials, count(*) FILTER (author IS NULL) AS n_missing_author, count(*) FILTER (response IS NULL) AS n_missing_own, count(*) FILTER (author IS NOT NULL AND response IS NOT NULL) AS n_compared, count(*) FILTER (author <> response) AS n_disagreed, round(CASE WHEN count(*) FILTER (author IS NOT NULL AND response IS NOT NULL) > 0 THEN 1 - count(*) FILTER (author <> response) / count(*) FILTER (author IS NOT NULL AND response IS NOT NULL) END, 6) AS agreement FROM a {g}"


@query(f"WITH {TRIALS}, a AS (SELECT * REPLACE (CASE WHEN id % 11 = 3 THEN NULL ELSE response END AS response), CASE WHEN id % 7 = 0 THEN NULL ELSE value > 25 END AS author FROM labelled) {_AGREE.format(k='reward_block,', g='GROUP BY 1')}")
def label_agreement(spark, sf_dir):
    own = labelled(spark, sf_dir).withColumns({"author": F.when(F.col("id") % 7 != 0, F.col("value") > 25), "response": F.when(F.col("id") % 11 != 3, F.col("response"))})
    return Z.label_agreement(own, "response", "author", by=["reward_block"]).withColumn("agreement", F.round("agreement", 6))


# --- boundaries and bins -----------------------------------------------------------------------

_B = """bounds AS (SELECT source, subject, """ + ", ".join(f"min(CASE WHEN reward_block = '{b}' THEN start_time END) AS lo_{b}, max(CASE WHEN reward_block = '{b}' THEN stop_time END) AS hi_{b}" for b in B.BLOCKS) + """ FROM labelled GROUP BY 1, 2),
bd AS (""" + " UNION ALL ".join(f"SELECT source, subject, '{n}' AS transition, {d} AS direction, lo_{b} AS real_time, (lo_{a} + hi_{a}) / 2 AS pseudo_time, lo_{a} AS pre_start, hi_{a} AS pre_stop, hi_{b} AS post_stop, '{a}' AS pre_block, '{b}' AS post_block FROM bounds WHERE lo_{a} IS NOT NULL AND lo_{b} IS NOT NULL" for n, a, b, d in (("withdrawal", "engaged_1", "no_reward", -1), ("restoration", "no_reward", "engaged_2", 1))) + """),
marks AS (SELECT source, subject, transition, direction, 'real' AS anchor, real_time AS t0, pre_start AS c0, post_stop AS c1, pre_block AS b0, post_block AS b1 FROM bd UNION ALL SELECT source, subject, transition, direction, 'pseudo', pseudo_time, pre_start, pre_stop, pre_block, pre_block FROM bd),
near AS (SELECT c.*, m.transition, m.anchor, m.direction, m.t0, m.c0, m.c1, change_time - t0 AS rel, CASE WHEN change_time < t0 THEN 'pre' ELSE 'post' END AS side FROM cond c JOIN marks m USING (source)
  WHERE change_time >= c0 AND change_time < c1 AND reward_block = CASE WHEN change_time < t0 THEN b0 ELSE b1 END)"""
BOUNDS = f"{TRIALS}, {CONDITIONED}, {_B}"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.anchors(B.transition_boundaries(labelled(spark, sf_dir)))


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.with_condition(labelled(spark, sf_dir)).withColumn("latency", F.when(F.col("response"), F.col("value") / 100))


@query(f"WITH {BOUNDS} SELECT source, subject, transition, direction, anchor, round(t0, 3) AS anchor_time, round(c0, 3) AS cover_start, round(c1, 3) AS cover_stop FROM marks")
def transition_anchors(spark, sf_dir):
    return marks(spark, sf_dir).select("source", "subject", "transition", "direction", "anchor", *r("anchor_time", "cover_start", "cover_stop", digits=3))


@query(f"""WITH {BOUNDS}, g AS (SELECT source, subject, transition, anchor, k AS bin, t0 + k * {DAY} >= c0 AND t0 + (k + 1) * {DAY} <= c1 AS covered FROM marks CROSS JOIN (SELECT unnest(range(-5, 5)) AS k)),
 f AS (SELECT source, transition, anchor, CAST(floor(rel / {DAY}) AS INT) AS bin, count(*) AS n, count(*) FILTER (response) AS k, median(CASE WHEN response THEN value / 100 END) AS lat FROM near GROUP BY 1, 2, 3, 4)
 SELECT source, subject, transition, anchor, bin, covered, coalesce(n, 0) AS n_trials, coalesce(k, 0) AS n_responses, round(CASE WHEN covered AND n > 0 THEN k / n END, 6) AS response_rate, round(lat, 6) AS median_latency,
 CASE WHEN NOT covered THEN 'not_covered' WHEN coalesce(n, 0) = 0 THEN 'no_trials' ELSE 'pass' END AS status FROM g LEFT JOIN f USING (source, transition, anchor, bin)""")
def session_time_bins(spark, sf_dir):
    out = B.time_bins(eligible(spark, sf_dir), marks(spark, sf_dir), CONFIG)
    return out.select("source", "subject", "transition", "anchor", "bin", "covered", "n_trials", "n_responses", *r("response_rate", "median_latency"), "status")


_ORDINAL = """o AS (SELECT *, CASE WHEN side = 'post' THEN row_number() OVER (PARTITION BY source, transition, anchor, side ORDER BY change_time, idx) ELSE -row_number() OVER (PARTITION BY source, transition, anchor, side ORDER BY change_time DESC, idx DESC) END AS ord FROM near)"""


@query(f"""WITH {BOUNDS}, {_ORDINAL}, f AS (SELECT source, transition, anchor, CAST(CASE WHEN ord > 0 THEN floor((ord - 1) / 4) ELSE -1 - floor((-ord - 1) / 4) END AS INT) AS bin, count(*) AS n, count(*) FILTER (response) AS k FROM o WHERE abs(ord) <= 8 GROUP BY 1, 2, 3, 4)
 SELECT source, subject, transition, anchor, g.k AS bin, coalesce(n, 0) AS n_trials, coalesce(f.k, 0) AS n_responses, coalesce(n = 4, false) AS covered, round(CASE WHEN n = 4 THEN f.k / n END, 6) AS response_rate
 FROM marks CROSS JOIN (SELECT unnest(range(-2, 2)) AS k) g LEFT JOIN f ON f.source = marks.source AND f.transition = marks.transition AND f.anchor = marks.anchor AND f.bin = g.k""".replace("SELECT source, subject, transition, anchor, g.k", "SELECT marks.source, marks.subject, marks.transition, marks.anchor, g.k"))
def session_trial_bins(spark, sf_dir):
    out = B.trial_bins(eligible(spark, sf_dir), marks(spark, sf_dir), CONFIG)
    return out.select("source", "subject", "transition", "anchor", "bin", "n_trials", "n_responses", "covered", *r("response_rate"))


_WINDOWS = f"""win AS (SELECT source, subject, transition, anchor, direction, side, condition, count(*) AS n_trials, count(*) FILTER (response) AS k, count(*) FILTER (response) / count(*) AS rate, CASE WHEN count(*) >= CASE WHEN condition = 'go' THEN 5 ELSE 3 END THEN 'pass' ELSE 'too_few_trials' END AS status
 FROM near WHERE rel >= -{CONFIG.effect_window} AND rel < {CONFIG.effect_window} GROUP BY 1, 2, 3, 4, 5, 6, 7)"""
_EFFECTS = """wide AS (SELECT source, subject, transition, direction, condition, sum(n_trials) AS n_trials, """ + ", ".join(f"max(CASE WHEN anchor = '{a}' AND side = '{s}' AND status = 'pass' THEN rate END) AS {a}_{s}" for a in ("real", "pseudo") for s in ("pre", "post")) + """ FROM win GROUP BY 1, 2, 3, 4, 5),
eff AS (SELECT source, subject, transition, condition, n_trials, direction * (real_post - real_pre) AS real_step, direction * (pseudo_post - pseudo_pre) AS pseudo_step, direction * (real_post - real_pre) - direction * (pseudo_post - pseudo_pre) AS controlled_step FROM wide),
alleff AS (SELECT * FROM eff UNION ALL SELECT source, subject, transition, 'go_minus_catch', sum(n_trials), max(CASE WHEN condition = 'go' THEN real_step END) - max(CASE WHEN condition = 'catch' THEN real_step END),
 max(CASE WHEN condition = 'go' THEN pseudo_step END) - max(CASE WHEN condition = 'catch' THEN pseudo_step END), max(CASE WHEN condition = 'go' THEN controlled_step END) - max(CASE WHEN condition = 'catch' THEN controlled_step END) FROM eff GROUP BY 1, 2, 3)"""


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.specificity(B.transition_effects(B.effect_windows(eligible(spark, sf_dir), marks(spark, sf_dir), CONFIG)))


@query(f"WITH {BOUNDS}, {_WINDOWS}, {_EFFECTS} SELECT source, transition, condition, n_trials, round(real_step, 6) AS real_step, round(pseudo_step, 6) AS pseudo_step, round(controlled_step, 6) AS controlled_step, controlled_step IS NOT NULL AS is_estimable FROM alleff")
def session_transition_effects(spark, sf_dir):
    return effects(spark, sf_dir).select("source", "transition", "condition", "n_trials", *r("real_step", "pseudo_step", "controlled_step"), "is_estimable")


@query(f"WITH {BOUNDS}, {_WINDOWS}, {_EFFECTS} SELECT subject, transition, condition, round(avg(real_step), 6) AS real_step, round(avg(controlled_step), 6) AS controlled_step, count(real_step) AS n_real_step, count(controlled_step) AS n_controlled_step, count(*) AS n_units FROM alleff GROUP BY 1, 2, 3")
def subject_transition_effects(spark, sf_dir):
    out = Z.equal_weight_means(effects(spark, sf_dir), ["real_step", "controlled_step"], by=["subject", "transition", "condition"])
    return out.select("subject", "transition", "condition", *r("real_step", "controlled_step"), "n_real_step", "n_controlled_step", "n_units")


@query(f"""WITH {BOUNDS}, {_WINDOWS} SELECT transition, anchor, side, condition, count(*) AS n, min(n_trials) AS least, max(n_trials) AS most, sum(n_trials) AS total, {', '.join(f"round(quantile_cont(n_trials, {q}), 6) AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM win GROUP BY 1, 2, 3, 4""")
def effect_window_support(spark, sf_dir):
    out = Z.support_distribution(B.effect_windows(eligible(spark, sf_dir), marks(spark, sf_dir), CONFIG), by=["transition", "anchor", "side", "condition"])
    return out.select("transition", "anchor", "side", "condition", "n", "least", "most", "total", *r("p05", "p25", "p50", "p75", "p95"))


@query(f"""WITH {BOUNDS}, b AS (SELECT subject, source, transition, anchor, CAST(floor(rel / {DAY}) AS INT) AS bin, count(*) FILTER (response) / count(*) AS rate, t0, c0, c1 FROM near GROUP BY 1, 2, 3, 4, 5, t0, c0, c1),
 v AS (SELECT * FROM b WHERE bin BETWEEN -5 AND 4 AND t0 + bin * {DAY} >= c0 AND t0 + (bin + 1) * {DAY} <= c1) SELECT subject, transition, anchor, bin, round(avg(rate), 6) AS response_rate, count(*) AS n_response_rate FROM v GROUP BY 1, 2, 3, 4""")
def subject_time_bins(spark, sf_dir):
    bins = B.time_bins(eligible(spark, sf_dir), marks(spark, sf_dir), CONFIG)
    return Z.equal_weight_means(bins, ["response_rate"], by=["subject", "transition", "anchor", "bin"]).where("n_response_rate > 0").select("subject", "transition", "anchor", "bin", *r("response_rate"), "n_response_rate")


# --- range, as-of and other joins -----------------------------------------------------------------

_SPK = "sp AS (SELECT source, event_type AS unit, start_time AS t FROM trials)"


@query(f"""WITH {TRIALS}, {_SPK}, e AS (SELECT source, id, change_time AS c FROM labelled WHERE go), g AS (SELECT e.source, e.id, e.c, u.unit FROM e JOIN (SELECT DISTINCT source, unit FROM sp) u USING (source)),
 k AS (SELECT g.source, g.id, g.unit, count(*) FILTER (t >= c - 43200 AND t < c) AS before, count(*) FILTER (t >= c AND t < c + 43200) AS after FROM g LEFT JOIN sp ON sp.source = g.source AND sp.unit = g.unit GROUP BY 1, 2, 3)
 SELECT *, round(sqrt(after + 0.375) - sqrt(before + 0.375), 6) AS feature FROM k""")
def spike_features(spark, sf_dir):
    """Points of each unit before and after each event, by a bucketed range join."""
    out = J.count_in_windows(spikes(spark, sf_dir), labelled(spark, sf_dir).where("go"), by=["source"], point="t", event="change_time", windows={"before": (-43200.0, 0.0), "after": (0.0, 43200.0)}, unit=["unit"], event_key=["id"])
    return out.withColumn("feature", F.round(stabilized(F.col("after")) - stabilized(F.col("before")), 6))


@query(f"""WITH {TRIALS}, {_SPK}, e AS (SELECT source, reward_block, change_time AS c FROM labelled WHERE "catch"), h AS (SELECT e.reward_block, unit, CAST(floor((t - c + 86400) / 21600) AS INT) AS bin FROM e JOIN sp USING (source) WHERE t >= c - 86400 AND t < c + 86400)
 SELECT reward_block, unit, bin, count(*) AS n FROM h GROUP BY 1, 2, 3""")
def event_histogram(spark, sf_dir):
    events = labelled(spark, sf_dir).where("catch")
    out = J.histogram_around(spikes(spark, sf_dir), events, by=["source"], point="t", event="change_time", start=-86400.0, width=21600.0, bins=8, unit=["unit"], event_key=["id", "reward_block"])
    return out.groupBy("reward_block", "unit", "bin").agg(F.sum("n").alias("n")).where("n > 0")


@query(f"""WITH {TRIALS}, s AS (SELECT source, start_time AS t, max(value) AS v FROM trials WHERE event_type = 'view' GROUP BY 1, 2), e AS (SELECT source, id, change_time AS c FROM trials WHERE event_type = 'click'),
 j AS (SELECT e.id, arg_min(v, abs(t - c) * 1e6 + (t > c)::INT) AS v, min(abs(t - c)) AS d FROM e LEFT JOIN s USING (source) GROUP BY 1) SELECT id, CASE WHEN d <= 86400 THEN round(v, 6) END AS nearest_value FROM j""")
def nearest_sample(spark, sf_dir):
    """The view nearest to each click within a day."""
    t = trials(spark, sf_dir)
    out = J.nearest(t.where("event_type = 'click'").select("source", "id", "change_time"), t.where("event_type = 'view'").select("source", F.col("start_time").alias("t"), "value"), by=["source"], time="change_time", sample_time="t", value="value", tolerance=DAY, name="nearest_value")
    return out.select("id", *r("nearest_value"))


@query(f"WITH {UNITS}, n AS (SELECT source, subject, region, count(*) AS n FROM units GROUP BY 1, 2, 3), p AS (SELECT a.source, a.subject, a.region AS source_region, b.region AS target_region, a.n AS s, b.n AS t FROM n a JOIN n b ON a.source = b.source AND a.region <> b.region WHERE a.n >= 2 AND b.n >= 2),"
       " m AS (SELECT subject, source_region, target_region, count(*) AS n, avg(s) AS s, avg(t) AS t FROM p GROUP BY 1, 2, 3) SELECT source_region, target_region, count(*) AS n_subjects, sum(n) AS n_sessions, round(median(s), 6) AS median_source, round(median(t), 6) AS median_target FROM m GROUP BY 1, 2")
def region_pair_coverage(spark, sf_dir):
    _, pairs = J.region_pairs(units(spark, sf_dir), source="source", subject="subject", region="region", minimum=2)
    return pairs.select("source_region", "target_region", "n_subjects", "n_sessions", *r("median_source", "median_target"))


@query("""WITH l AS (SELECT l_orderkey AS source, l_linenumber AS line, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2), f AS (SELECT source, line * 3 + source % 5 AS frame, label FROM l WHERE NOT (source % 7 = 0 AND line = 1)), a AS (SELECT source, line, line * 3 - 10 AS af, label FROM l WHERE source % 3 <> 0 OR line % 2 = 1),
 t AS (SELECT source, count(*) AS n FROM a GROUP BY 1), o AS (SELECT a.source, f.frame - af AS d, count(DISTINCT a.line) AS ids, count(DISTINCT f.frame) AS fs FROM a JOIN f ON a.source = f.source AND a.label = f.label GROUP BY 1, 2) SELECT o.source, any_value(d) AS "offset" FROM o JOIN t USING (source) WHERE ids = n AND fs = n GROUP BY 1 HAVING count(*) = 1""")
def frame_offsets(spark, sf_dir):
    """Each order's lines as frames with labels that recur, and its anchors shifted by an offset: some orders leave several offsets, some lack a frame and leave none."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("line")).agg(F.min("l_returnflag").alias("label"))
    frames = l.where("not (source % 7 = 0 and line = 1)").withColumn("frame", F.col("line") * 3 + F.col("source") % 5)
    anchors = l.where("source % 3 <> 0 or line % 2 = 1").withColumn("anchor_frame", F.col("line") * 3 - 10)
    return J.frame_offsets(anchors, frames, source="source", anchor_id="line", anchor_frame="anchor_frame", frame="frame", label="label", parts=parts_of(table(spark, sf_dir, "lineitem"))).select("source", "offset")


@query(f"""WITH {IMAGES}, k AS (SELECT source, start_frame, count(*) AS n, min(image_name) AS img FROM images GROUP BY 1, 2), a AS (SELECT l_suppkey AS source, l_orderkey * 10 + l_linenumber - 7 AS af, l_quantity FROM lineitem)
 SELECT a.source % 10 AS grp, count(*) AS n_anchors, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n > 1) AS n_ambiguous, count(*) FILTER (n IS NULL) AS n_unmatched FROM a LEFT JOIN k ON k.source = a.source AND k.start_frame = a.af + 7 GROUP BY 1""")
def frame_alignment(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    anchors = l.select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") - 7).alias("af"), (F.col("l_orderkey") * 10.0 + F.col("l_linenumber")).alias("event"))
    frames = images(spark, sf_dir).select("source", "start_frame", "image_name", F.col("start_frame").cast("double").alias("start"), (F.col("start_frame") + 1.0).alias("stop"))
    offsets = anchors.select("source").distinct().withColumn("offset", F.lit(7))
    out = J.align_by_offset(anchors.withColumn("image_name", F.lit(None).cast("string")), frames, offsets, source="source", anchor_frame="af", frame="start_frame", values=["image_name"], start="start", stop="stop", event="event")
    return out.groupBy((F.col("source") % 10).alias("grp")).agg(F.count("*").alias("n_anchors"), F.count_if(F.expr("match_count = 1")).alias("n_single"), F.count_if(F.expr("match_count > 1")).alias("n_ambiguous"), F.count_if(F.expr("match_count = 0")).alias("n_unmatched"))


@query("SELECT n_regionkey AS division, count(*) AS n_nodes, sum(c) AS n_leaves FROM (SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation) GROUP BY 1")
def tree_divisions(spark, sf_dir):
    """A tree of regions, nations and customers: each node's path by recursion, and its one ancestor among the regions."""
    n, g, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    edges = g.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
    paths = J.tree_paths(edges, node="node", parent="parent")
    found = J.ancestor_division(paths, g.select(F.concat(F.lit("r"), "r_regionkey").alias("division")), node="node", path="path", division="division").where("node like 'n%'")
    leaves = c.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("node")).agg(F.count("*").alias("c"))
    out = J.join_checked(found, leaves, ["node"], "left", "1:1").groupBy("division").agg(F.count("*").alias("n_nodes"), F.sum("c").alias("n_leaves"))
    return out.select(F.substring("division", 2, 9).cast("int").alias("division"), "n_nodes", "n_leaves")


@query(f"""WITH {TRIALS}, c AS (SELECT user_id AS source, day(ts) AS d, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END AS flag FROM events WHERE event_id % 10 <> 0)
 SELECT source, d AS "day", arg_min(flag, CASE WHEN flag IS NOT NULL THEN event_id END) AS flag, count(DISTINCT flag) AS n_flags, count(*) AS n_rows, min(event_id) AS first_row, max(event_id) AS last_row, count(DISTINCT flag) > 1 AS conflict FROM c GROUP BY 1, 2""")
def companion_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.dayofmonth("ts").alias("day"), "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0).alias("flag"))
    return S.companion_flags(e, keys=["source", "day"], flag="flag", row="event_id", valid=F.col("event_id") % 10 != 0)


@query(f"""WITH {TRIALS}, t AS (SELECT source, id, CASE WHEN id % 4 = 0 THEN NULL ELSE no_reward END AS own, CASE WHEN source % 3 = 0 THEN NULL ELSE id % 8 < 4 END AS other FROM trials)
 SELECT source, count(*) AS n_trials, count(own) AS n_primary, count(*) FILTER (own IS NULL AND other IS NOT NULL) AS n_companion, count(*) FILTER (own IS NULL AND other IS NULL) AS n_missing, count(*) FILTER (own <> other) AS n_conflicts,
 CASE WHEN count(*) FILTER (own <> other) > 0 THEN 'conflict' WHEN count(*) FILTER (own IS NULL AND other IS NULL) > 0 THEN 'missing_flags' ELSE 'pass' END AS status FROM t GROUP BY 1""")
def reward_flag_audit(spark, sf_dir):
    """Flags filled from a companion table with a checked m:1 join, and their audit per session."""
    t = trials(spark, sf_dir)
    primary = t.select("source", "id", F.when(F.col("id") % 4 != 0, F.col("no_reward")).alias("flag"))
    companion = t.where("source % 3 <> 0").select("source", "id", (F.col("id") % 8 < 4).alias("other"))
    return Z.flag_audit(J.fill_flag(primary, companion, ["source", "id"], "flag", "other"), t.select("source").distinct())


@query("SELECT o_custkey, 'left' AS side FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def key_reconciliation(spark, sf_dir):
    return J.unmatched(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


# --- units, images, inventories --------------------------------------------------------------------


@query(f"""WITH {UNITS}, q AS (SELECT *, isi_violations < 0.5 AND amplitude_cutoff IS NOT NULL AND amplitude_cutoff < 0.1 AND quality = 'good' AS w, concat_ws(';', CASE WHEN isi_violations >= 0.5 THEN 'isi_violations_above_threshold' END, CASE WHEN amplitude_cutoff IS NULL THEN 'amplitude_cutoff_invalid' END,
 CASE WHEN amplitude_cutoff >= 0.1 THEN 'amplitude_cutoff_above_threshold' END, CASE WHEN quality <> 'good' THEN 'quality_not_good' END) AS reasons FROM units)
 SELECT source, unit, coalesce(w, false) AS is_well_isolated, reasons AS exclusion_reasons, 'e' || peak_channel AS electrode, source || ':' || unit AS unit_key FROM q""")
def unit_inventory(spark, sf_dir):
    u = units(spark, sf_dir)
    electrodes = u.select("source", "peak_channel").distinct().withColumn("electrode", F.concat(F.lit("e"), "peak_channel"))
    return S.unit_inventory(u.drop("subject"), electrodes, u.select("source", "subject").distinct()).select("source", "unit", "is_well_isolated", "exclusion_reasons", "electrode", "unit_key")


@query(f"WITH {UNITS} SELECT coalesce(CAST(CASE WHEN region = 3 THEN NULL ELSE region END AS VARCHAR), '[missing]') AS region, count(DISTINCT subject) AS n_subjects, count(DISTINCT source) AS n_sources, count(DISTINCT peak_channel) AS n_channels, count(*) AS n_units FROM units GROUP BY 1")
def anatomy_coverage(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("region", F.when(F.col("region") != 3, F.col("region")))
    return Z.coverage(u, by=["region"], distinct={"n_subjects": "subject", "n_sources": "source", "n_channels": "peak_channel"})


@query(f"""WITH {UNITS} SELECT source, unit, CASE WHEN region % 4 = 0 THEN NULL WHEN region = 1 THEN NULL ELSE 'R' || region END AS region, CASE WHEN region % 4 = 0 THEN 'no_label' WHEN region = 1 THEN 'outside_regions' WHEN peak_channel = 5 THEN 'no_electrode' WHEN region = 7 THEN 'unmapped' ELSE 'included' END AS anatomy_status FROM units""")
def unit_anatomy(spark, sf_dir):
    u = units(spark, sf_dir)
    labels = u.where("region % 4 <> 0").select("source", "unit", F.when(F.col("region") == 1, "root").otherwise(F.concat(F.lit(" R"), "region")).alias("label"))
    electrodes = u.where("peak_channel <> 5").select("source", "peak_channel").distinct().withColumn("x", F.lit(1.0))
    ontology = u.where("region <> 7").select(F.concat(F.lit("R"), "region").alias("acronym"), (F.col("region") % 3).alias("division")).distinct()
    return Z.unit_anatomy(u.drop("region"), labels, electrodes, ontology).select("source", "unit", "region", "anatomy_status")


@query(f"""WITH {UNITS}, z AS (SELECT source, subject, region, (weight - avg(weight) OVER (PARTITION BY source)) / nullif(stddev_pop(weight) OVER (PARTITION BY source), 0) AS z FROM units), s AS (SELECT subject, source, region, avg(z) AS z FROM z GROUP BY 1, 2, 3)
 SELECT subject, region, round(avg(z), 6) AS z_weight, count(*) AS n_units FROM s GROUP BY 1, 2""")
def region_effects(spark, sf_dir):
    """Weights standardised within sources, then equal-source means by subject and region."""
    return Z.equal_weight_means(B.zscore(units(spark, sf_dir), ["weight"], by=["source"]), ["z_weight"], by=["subject", "region"]).select("subject", "region", *r("z_weight"), "n_units")


@query(f"""WITH {IMAGES} SELECT source, start_frame, idx, 'im' || p_size AS image_id, CAST(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.7 END AS DOUBLE) AS contrast, count(*) OVER (PARTITION BY source, image_name ORDER BY start_frame, idx ROWS UNBOUNDED PRECEDING) AS exposure, 'im' || p_size = 'im' || (source % 50 + 1) AS is_designated_novel FROM images""")
def task_presentations(spark, sf_dir):
    i = images(spark, sf_dir)
    novel = i.select("source").distinct().withColumn("novel_image", F.concat(F.lit("im"), (F.col("source") % 50 + 1).cast("string")))
    return S.task_presentations(i, novel, parts=parts_of(table(spark, sf_dir, "lineitem"))).select("source", "start_frame", "idx", "image_id", "contrast", "exposure", "is_designated_novel")


@query(f"WITH {IMAGES} SELECT p_size % 5 AS grp, is_change, omitted, image_name, count(*) AS n, min(start_frame) AS first_frame, max(start_frame) AS last_frame FROM images GROUP BY 1, 2, 3, 4")
def stimulus_inventory(spark, sf_dir):
    return images(spark, sf_dir).groupBy((F.col("p_size") % 5).alias("grp"), "is_change", "omitted", "image_name").agg(F.count("*").alias("n"), F.min("start_frame").alias("first_frame"), F.max("start_frame").alias("last_frame"))


@query(f"""WITH {IMAGES}, g AS (SELECT source, s FROM (SELECT DISTINCT source FROM images) CROSS JOIN (SELECT unnest([true, false]) AS s)), k AS (SELECT source, is_change AS s, count(*) FILTER (p_size % 2 = 0) AS f, count(*) FILTER (p_size % 2 <> 0) AS d FROM images GROUP BY 1, 2)
 SELECT source, s AS is_change, coalesce(f, 0) AS n_full, coalesce(d, 0) AS n_reduced, coalesce(f, 0) > 0 AND coalesce(d, 0) > 0 AS both_present FROM g LEFT JOIN k USING (source, s)""")
def stimulus_estimability(spark, sf_dir):
    i = images(spark, sf_dir)
    grid = i.select("source").distinct().withColumn("is_change", F.explode(F.array(F.lit(True), F.lit(False))))
    out = Z.complete_counts(i, grid, ["source", "is_change"], n_full=image_contrast("image_name") == 1, n_reduced=image_contrast("image_name") < 1)
    return out.withColumn("both_present", (F.col("n_full") > 0) & (F.col("n_reduced") > 0))


@query(f"""WITH {IMAGES}, x AS (SELECT source, start_frame, idx, image_name, p_size, 'im' || p_size = 'im' || (source % 50 + 1) AS novel FROM images),
 p AS (SELECT source, 'contrast' AS probe, CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'reduced' END AS probe_condition FROM x WHERE p_size = 15 UNION ALL SELECT source, 'novelty', CASE WHEN novel THEN 'novel' ELSE 'familiar' END FROM x WHERE p_size % 2 = 0) SELECT source, probe, probe_condition, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def probe_conditions(spark, sf_dir):
    i = images(spark, sf_dir).withColumn("is_designated_novel", image_identity("image_name") == F.concat(F.lit("im"), (F.col("source") % 50 + 1).cast("string")))
    return Z.probe_conditions(i, image="image_name", contrast_image="im15").groupBy("source", "probe", "probe_condition").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN url LIKE '%.com/%' THEN 'com' ELSE 'other' END AS kind, count(*) AS n_assets, sum(length(html)) AS n_bytes, count(DISTINCT page_id % 5) AS n_subjects, count(*) FILTER (url NOT LIKE '%.com/%' AND page_id % 7 = 0) AS n_media FROM pages GROUP BY 1")
def asset_manifest(spark, sf_dir):
    """Pages as assets: session files by path, with counts by kind."""
    p = table(spark, sf_dir, "pages")
    path = F.when(F.col("url").contains(".com/"), F.concat(F.lit("sub-"), F.col("page_id") % 5, F.lit("/sub-"), F.col("page_id") % 5, F.lit("_ses-20240101T"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".nwb"))).otherwise(F.concat(F.lit("sub-"), F.col("page_id") % 5, F.lit("/x"), F.col("page_id"), F.when(F.col("page_id") % 7 == 0, ".MP4").otherwise("")))
    m = S.asset_manifest(p.withColumns({"path": path, "size": F.length("html")}), asset_id="page_id", path="path", size="size")
    return S.manifest_summary(m).withColumn("kind", F.when(F.col("kind") == "session", "com").otherwise("other"))


@query("""WITH c AS (SELECT o_custkey AS source, o_orderpriority AS tbl, list(DISTINCT o_orderstatus) AS cols FROM orders GROUP BY 1, 2), k AS (SELECT source, tbl, list_contains(cols, 'O') AND list_contains(cols, 'F') AND tbl NOT LIKE '%LOW%' AS ok FROM c)
 SELECT source, count(*) FILTER (ok) AS n_candidates, CASE WHEN count(*) FILTER (ok) = 1 THEN min(CASE WHEN ok THEN tbl END) END AS tbl FROM k GROUP BY 1""")
def presentation_tables(spark, sf_dir):
    """Orders as a catalog of (source, table, column): the one table per source with the required columns."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("tbl"), F.col("o_orderstatus").alias("col"))
    return S.presentation_tables(o, source="source", table="tbl", column="col", required=["O", "F"], not_pattern="LOW")


@query("""SELECT c_mktsegment AS table_id, count(*) AS n_sources, count(*) FILTER (n > 0) AS n_present FROM (SELECT n_nationkey AS s, seg AS c_mktsegment, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n_nationkey AND c.c_mktsegment = seg AND c.c_acctbal > 9000) AS n
 FROM (SELECT DISTINCT c_nationkey AS n_nationkey FROM customer WHERE c_acctbal > 9000) CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)) GROUP BY 1""")
def schema_audit(spark, sf_dir):
    """Customers as a catalog: which source has which required column, and of what type."""
    c = table(spark, sf_dir, "customer")
    catalog = c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("table_id"), F.lit("v").alias("column"), F.lit("double").alias("dtype"))
    required = c.select(F.col("c_mktsegment").alias("table_id")).distinct().withColumns({"column": F.lit("v"), "expected": F.lit("numeric"), "is_required": F.lit(True)})
    audit = X.schema_audit(catalog, required)
    return X.schema_summary(audit, X.schema_variants(catalog)).select("table_id", "n_sources", "n_present")


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_mktsegment END), ''), '<missing>') AS category, CASE WHEN c_nationkey > 0 AND c_custkey % 2 = 0 THEN c_nationkey END AS recording_day FROM customer")
def subject_categories(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    number = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 1)
    return c.select("c_custkey", normalized_category(F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_mktsegment"))).alias("category"), recording_day(F.concat(F.lit("EPHYS_"), "c_nationkey"), number).alias("recording_day"))


@query("SELECT rule, n_violations FROM (SELECT 'unique_key' AS rule, (SELECT count(*) - count(DISTINCT k) FROM (SELECT CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 1 WHEN o_orderkey % 101 <> 0 THEN o_orderkey END AS k FROM orders)) AS n_violations UNION ALL SELECT 'total_positive', (SELECT count(*) FROM orders WHERE NOT o_totalprice > 1000) UNION ALL SELECT 'coverage', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL SELECT 'constant_within_group', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)))")
def order_expectations(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.when(F.col("o_orderkey") % 50 == 7, F.col("o_orderkey") - 1).when(F.col("o_orderkey") % 101 != 0, F.col("o_orderkey"))
    return X.all_of(X.expect_unique(o.select(key.alias("o_orderkey")), ["o_orderkey"]), X.expect_rows(o, {"total_positive": F.col("o_totalprice") > 1000}), X.expect_coverage(o, c.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]), X.expect_constant(o, ["o_custkey"], ["o_orderstatus"]))


@query(f"WITH {TRIALS} SELECT 'contiguous_index' AS rule, (SELECT count(*) FROM (SELECT source FROM labelled WHERE id % 97 <> 5 GROUP BY 1 HAVING min(idx) <> 0 OR max(idx) <> count(*) - 1)) AS n_violations UNION ALL SELECT 'minimum_support', (SELECT count(*) FROM (SELECT s.source, b.b, (SELECT count(*) FROM labelled l WHERE l.source = s.source AND l.reward_block = b.b AND go) AS n FROM (SELECT DISTINCT source FROM labelled) s CROSS JOIN (SELECT unnest(['engaged_1', 'no_reward', 'engaged_2']) AS b) b) WHERE n < 8)")
def trial_expectations(spark, sf_dir):
    t = labelled(spark, sf_dir)
    grid = t.select("source").distinct().withColumn("reward_block", F.explode(F.array(*[F.lit(b) for b in B.BLOCKS])))
    return X.all_of(X.expect_contiguous(t.where("id % 97 <> 5"), "source", "idx"), X.expect_minimum(t, ["source", "reward_block"], F.col("go"), 8, grid=grid))


# --- estimates, windows over ordered rows ------------------------------------------------------------

_EST_BLOCKS = """eb AS (SELECT subject, segment, reward_block, count(*) AS n_trials, avg(score) AS score, avg(response::INT) AS response FROM estimates GROUP BY 1, 2, 3)"""


@query(f"""WITH {ESTIMATES}, {_EST_BLOCKS}, w AS (SELECT subject, segment, {', '.join(f"max(CASE WHEN reward_block = '{b}' THEN score END) AS s_{b}, max(CASE WHEN reward_block = '{b}' THEN response END) AS r_{b}, coalesce(max(CASE WHEN reward_block = '{b}' THEN n_trials END), 0) AS n_{b}" for b in B.BLOCKS)} FROM eb GROUP BY 1, 2),
 l AS (SELECT subject, segment, 'score' AS metric, s_engaged_1 AS a, s_no_reward AS b, s_engaged_2 AS c, least(n_engaged_1, n_no_reward, n_engaged_2) >= 5 AS ok FROM w UNION ALL SELECT subject, segment, 'response', r_engaged_1, r_no_reward, r_engaged_2, least(n_engaged_1, n_no_reward, n_engaged_2) >= 5 FROM w)
 SELECT subject, segment, metric, round(CASE WHEN ok THEN 0.5 * a - b + 0.5 * c END, 6) AS contrast, CASE WHEN NOT ok THEN 'too_few_trials' ELSE 'pass' END AS status FROM l""")
def block_contrasts(spark, sf_dir):
    e = estimates(spark, sf_dir).groupBy("subject", "segment", "reward_block").agg(F.count("*").alias("n_trials"), F.avg("score").alias("score"), F.avg(F.col("response").cast("int")).alias("response"))
    return Z.block_contrasts(e, ["score", "response"], by=["subject", "segment"]).select("subject", "segment", "metric", *r("contrast"), "status")


@query(f"WITH {ESTIMATES}, m AS (SELECT subject, segment, avg(score) AS s FROM estimates GROUP BY 1, 2) SELECT subject, round(max(CASE WHEN segment = 'BUILDING' THEN s END) - max(CASE WHEN segment = 'MACHINERY' THEN s END), 6) AS difference FROM m GROUP BY 1 HAVING max(CASE WHEN segment = 'BUILDING' THEN s END) - max(CASE WHEN segment = 'MACHINERY' THEN s END) IS NOT NULL")
def condition_interaction(spark, sf_dir):
    e = estimates(spark, sf_dir).groupBy("subject", "segment").agg(F.avg("score").alias("score"))
    return Z.condition_difference(e, by=["subject"], condition="segment", test="BUILDING", reference="MACHINERY", value="score").withColumn("difference", F.round("difference", 6))


@query(f"""WITH {ESTIMATES}, p AS (SELECT *, row_number() OVER (PARTITION BY subject, reward_block ORDER BY placed, id) - 1 AS k, count(*) OVER (PARTITION BY subject, reward_block) AS n, ntile(3) OVER (PARTITION BY subject, reward_block ORDER BY placed, id) - 1 AS fold FROM estimates),
 m AS (SELECT subject, min(n) AS m FROM p GROUP BY 1) SELECT p.subject, reward_block, fold, count(*) AS n_rows, count(*) FILTER (list_contains(list_transform(range(m), lambda i: CAST(floor((i + 0.5) * n / m) AS BIGINT)), k)) AS n_chosen, count(*) FILTER (k % 2 = 1) AS n_odd FROM p JOIN m ON m.subject = p.subject GROUP BY 1, 2, 3""")
def balanced_folds(spark, sf_dir):
    """Contiguous folds, alternating halves and an evenly spaced choice of rows."""
    e = estimates(spark, sf_dir)
    order = ["placed", "id"]
    marked = B.alternating_half(B.contiguous_folds(e, 3, by=["subject", "reward_block"], order=order), by=["subject", "reward_block"], order=order)
    chosen = B.evenly_spaced(e, by=["subject"], group="reward_block", order=order).select("id", F.lit(True).alias("chosen"))
    return marked.join(chosen, "id", "left").groupBy("subject", "reward_block", "fold").agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce("chosen", F.lit(False))).alias("n_chosen"), F.count_if(F.col("half") == 1).alias("n_odd"))


@query(f"""WITH {ESTIMATES}, p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY placed, id) - 1 AS k, count(*) OVER (PARTITION BY subject) AS n FROM estimates) SELECT a.id, a.score, b.score AS shifted_score FROM p a JOIN p b ON a.subject = b.subject AND b.k = (a.k + CAST(floor(a.n / 2) AS BIGINT)) % a.n""")
def cyclic_shift(spark, sf_dir):
    return B.cyclic_shift(estimates(spark, sf_dir), "score", by=["subject"], order=["placed", "id"]).select("id", "score", "shifted_score")


@query(f"""WITH {TRIALS}, s AS (SELECT source, id, CASE WHEN id % 13 = 0 THEN NULL ELSE floor(start_time / 3600) END AS t, value AS v FROM trials) SELECT source, t, round(avg(v), 6) AS v, count(*) AS n_merged FROM s WHERE t IS NOT NULL GROUP BY 1, 2""")
def prepared_samples(spark, sf_dir):
    s = trials(spark, sf_dir).select("source", "id", F.when(F.col("id") % 13 != 0, F.floor(F.col("start_time") / 3600).cast("double")).alias("t"), F.col("value").alias("v"))
    return B.prepared_samples(s, source="source", index="id", time="t", value="v")[0].withColumn("v", F.round("v", 6))


@query(f"""WITH {TRIALS}, s AS (SELECT source % 40 AS source, id, CASE WHEN id % 13 = 0 OR (source % 9 = 2 AND id % 3 <> 0) THEN NULL WHEN source % 9 = 4 THEN 7 WHEN source % 40 < 20 THEN id ELSE floor(start_time / 3600) END AS t, value AS v FROM trials),
 d AS (SELECT *, t - lag(t) OVER (PARTITION BY source ORDER BY id) AS step FROM s WHERE t IS NOT NULL), k AS (SELECT source, count(*) FILTER (step < 0) AS n_decreasing, count(*) FILTER (step = 0) AS n_repeated_next, count(*) - count(DISTINCT t) AS n_repeated, count(DISTINCT t) AS n_times FROM d GROUP BY 1)
 SELECT source, count(*) AS n_raw, count(*) FILTER (t IS NULL) AS n_invalid, coalesce(any_value(n_decreasing), 0) AS n_decreasing, coalesce(any_value(n_repeated_next), 0) AS n_repeated_next, coalesce(any_value(n_repeated), 0) AS n_repeated, coalesce(any_value(n_times), 0) AS n_times,
 CASE WHEN coalesce(any_value(n_times), 0) < 2 THEN 'unavailable' WHEN count(*) FILTER (t IS NULL) + any_value(n_decreasing) + any_value(n_repeated) > 0 THEN 'repaired' ELSE 'pass' END AS status FROM s LEFT JOIN k USING (source) GROUP BY 1""")
def sample_status(spark, sf_dir):
    """What was wrong with each source's samples, and whether they are usable, repaired or as they should be."""
    source, key = F.col("source"), F.col("id")
    t = F.when((key % 13 == 0) | ((source % 9 == 2) & (key % 3 != 0)), F.lit(None)).when(source % 9 == 4, 7.0).when(source % 40 < 20, key.cast("double")).otherwise(F.floor(F.col("start_time") / 3600).cast("double"))
    s = trials(spark, sf_dir).select((source % 40).alias("source"), "id", t.alias("t"), F.col("value").alias("v"))
    return B.prepared_samples(s, source="source", index="id", time="t", value="v")[1]


@query(f"""WITH {ESTIMATES}, k AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY score) + (count(*) OVER (PARTITION BY subject, score) - 1) / 2 AS rk FROM estimates), a AS (SELECT subject, sum(CASE WHEN response THEN rk END) AS s, count(*) FILTER (response) AS p, count(*) FILTER (NOT response) AS q FROM k GROUP BY 1)
 SELECT subject, round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) END, 6) AS auc FROM a""")
def score_auc(spark, sf_dir):
    return I.binary_auc(estimates(spark, sf_dir), "score", "response", by=["subject"]).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {ESTIMATES}, m AS (SELECT subject, 0.5 * avg(CASE WHEN response THEN score END) + 0.5 * avg(CASE WHEN NOT response THEN score END) AS l, 0.5 * avg(CASE WHEN response THEN score * score END) + 0.5 * avg(CASE WHEN NOT response THEN score * score END) AS s FROM estimates GROUP BY 1)
 SELECT subject, round(l, 6) AS location, round(sqrt(s - l * l), 5) AS scale FROM m""")
def balanced_moments(spark, sf_dir):
    return I.balanced_moments(estimates(spark, sf_dir), "score", "response", by=["subject"]).select("subject", *r("location"), *r("scale", digits=5))


# --- inference -----------------------------------------------------------------------------------

_SUBJ = f"{ESTIMATES}, sm AS (SELECT segment, subject, avg(score) - 140 AS v FROM estimates GROUP BY 1, 2)"


def subject_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates(spark, sf_dir).groupBy("segment", "subject").agg((F.avg("score") - 140).alias("v"))


@query(f"""WITH {_SUBJ}, a AS (SELECT segment, count(*) AS n, list(v ORDER BY subject) AS vs, avg(v) AS mean FROM sm GROUP BY 1), reps AS (SELECT unnest(range(500)) AS rep),
 d AS (SELECT segment, rep, n, vs, unnest(range(n)) AS i FROM a CROSS JOIN reps), x AS (SELECT segment, rep, avg(vs[1 + CAST(CAST('0x' || substr(md5(concat_ws('|', '7', segment, rep, i)), 1, 8) AS BIGINT) % n AS BIGINT)]) AS m FROM d GROUP BY 1, 2)
 SELECT segment, n, round(any_value(mean), 5) AS mean, round(quantile_cont(m, 0.025), 5) AS ci_low, round(quantile_cont(m, 0.975), 5) AS ci_high FROM x JOIN a USING (segment) GROUP BY 1, 2""")
def bootstrap_intervals(spark, sf_dir):
    return I.bootstrap_mean(subject_scores(spark, sf_dir), by=["segment"], unit="subject", value="v", seed=7, resamples=500).select("segment", "n", *r("mean", "ci_low", "ci_high", digits=5))


@query(f"""WITH {_SUBJ}, a AS (SELECT segment, n_regionkey AS region, list(v ORDER BY subject) AS vs, abs(sum(v)) AS seen, count(*) AS n FROM sm JOIN nation ON subject = n_nationkey GROUP BY 1, 2), f AS (SELECT segment, region, n, seen, list_sum(list_transform(range(len(vs)), lambda i: CASE WHEN (flip // CAST(pow(2, i) AS BIGINT)) % 2 = 1 THEN vs[i + 1] ELSE -vs[i + 1] END)) AS t FROM a JOIN (SELECT unnest(range(1024)) AS flip) ON flip < pow(2, len(vs)))
 SELECT segment, region, any_value(n) AS n, round(count(*) FILTER (abs(t) >= seen - 1e-9) / count(*), 6) AS p_value, 'exact' AS method FROM f GROUP BY 1, 2""")
def sign_flip_exact(spark, sf_dir):
    """All flips in every segment and region: a region has few subjects, so none is left out."""
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject"), F.col("n_regionkey").alias("region"))
    scores = subject_scores(spark, sf_dir).join(regions, "subject")
    return I.sign_flip(scores, by=["segment", "region"], unit="subject", value="v").select("segment", "region", "n", *r("p_value"), "method")


@query(f"""WITH {_SUBJ}, a AS (SELECT segment, list(v ORDER BY subject) AS vs, count(*) AS n, abs(sum(v)) AS seen FROM sm GROUP BY 1), d AS (SELECT segment, seen, n, vs, rep FROM a CROSS JOIN (SELECT unnest(range(500)) AS rep)),
 f AS (SELECT segment, n, seen, rep, sum(CASE WHEN CAST('0x' || substr(md5(concat_ws('|', '3', segment, rep, i)), 1, 8) AS BIGINT) % 2 = 1 THEN vs[i + 1] ELSE -vs[i + 1] END) AS t FROM (SELECT *, unnest(range(n)) AS i FROM d) GROUP BY 1, 2, 3, 4)
 SELECT segment, n, round((count(*) FILTER (abs(t) >= seen - 1e-9) + 1) / (count(*) + 1), 6) AS p_value, 'sampled' AS method FROM f GROUP BY 1, 2""")
def sign_flip_sampled(spark, sf_dir):
    return I.sign_flip(subject_scores(spark, sf_dir), by=["segment"], unit="subject", value="v", seed=3, exact_up_to=5, resamples=500).select("segment", "n", *r("p_value"), "method")


@query("""WITH p AS (SELECT s_nationkey AS family, s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_suppkey * 37 % 1000) / 5000 END AS p FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, id) AS rk, count(p) OVER (PARTITION BY family) AS m FROM p)
 SELECT id, family, round(CASE WHEN p IS NOT NULL THEN max(CASE WHEN p IS NOT NULL THEN least(1.0, (m - rk + 1) * p) END) OVER (PARTITION BY family ORDER BY rk ROWS UNBOUNDED PRECEDING) END, 6) AS adjusted_p FROM k""")
def holm_adjusted(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("family"), F.when(F.col("s_suppkey") % 9 != 0, (F.col("s_suppkey") * 37 % 1000) / 5000).alias("p_value"))
    return I.holm(s, family=["family"], order=["id"]).select("id", "family", *r("adjusted_p"))


@query(f"""WITH {UNITS}, u AS (SELECT * FROM units), x AS (SELECT source, subject, unit, region, weight, rep, row_number() OVER (PARTITION BY source, rep ORDER BY unit) AS a, row_number() OVER (PARTITION BY source, rep ORDER BY md5(concat_ws('|', '5', rep, source, unit)), unit) AS b FROM u CROSS JOIN (SELECT unnest(range(20)) AS rep)),
 d AS (SELECT l.source, l.subject, l.region, l.rep, v.weight FROM x l JOIN x v ON l.source = v.source AND l.rep = v.rep AND l.a = v.b), s AS (SELECT rep, region, subject, source, avg(weight) AS m FROM d GROUP BY 1, 2, 3, 4), t AS (SELECT rep, region, subject, avg(m) AS m FROM s GROUP BY 1, 2, 3)
 SELECT region, rep, round(avg(m), 8) AS mean FROM t GROUP BY 1, 2""")
def permutation_null(spark, sf_dir):
    return I.permutation_null(units(spark, sf_dir), session="source", subject="subject", unit="unit", label="region", value="weight", permutations=20, seed=5).withColumn("mean", F.round("mean", 8))


SPECIFICATION = [
    *[I.Statistic(f"score__{x.lower()}", f"score_{x}", f"{x.lower()}_minus_140", "the mean order differs from 140", "thousands", "primary", 0.0, "scores", True) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE")],
    I.Statistic("score__against_half", "score_BUILDING", "building_minus_140_half", "the mean order differs from 140.5", "thousands", null_value=0.5, family="sensitivity", tested=True, notes="the same metric against another null value"),
    I.Statistic("share__building", "share_BUILDING", "urgent_share", "describes the share of urgent orders", "share", "secondary", family="shares"), I.Statistic("one__region", "one_nation", "one", "one nation only", "share"), I.Statistic("none", "absent", "none", "no such metric", "share", family="scores", tested=True),
]
_SPEC_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (bool, float)) else f"'{v}'" for v in (s.result_id, s.metric, s.contrast_id, s.hypothesis, s.scale, s.tier, s.null_value, s.family, s.tested, s.notes)) + ")" for s in SPECIFICATION)
_STATISTICS = f"""WITH {ESTIMATES}, spec(result_id, metric, contrast_id, hypothesis, scale, tier, null_value, family, tested, notes) AS (VALUES {_SPEC_ROWS}),
 base AS (SELECT segment, subject, avg(score) - 140 AS v, avg(CAST(response AS INT)) AS w, count(DISTINCT source) AS n_sessions, count(*) AS n_trials FROM estimates GROUP BY 1, 2), long AS (SELECT 'score_' || segment AS metric, subject, v, n_sessions, n_trials FROM base UNION ALL SELECT 'share_' || segment, subject, w, n_sessions, n_trials FROM base UNION ALL SELECT 'one_nation', subject, w, n_sessions, n_trials FROM base WHERE subject = 0 AND segment = 'BUILDING'),
 rowsof AS (SELECT s.result_id, s.null_value, s.tested, l.* EXCLUDE (metric) FROM long l JOIN spec s USING (metric)), a AS (SELECT result_id, any_value(null_value) AS nv, any_value(tested) AS tested, count(*) AS n, list(v ORDER BY subject) AS vs, avg(v) AS mean, abs(sum(v - null_value)) AS seen, sum(n_sessions) AS n_sessions, sum(n_trials) AS n_trials FROM rowsof GROUP BY 1),
 reps AS (SELECT unnest(range(500)) AS rep), bd AS (SELECT result_id, rep, n, vs, unnest(range(n)) AS i FROM a CROSS JOIN reps WHERE n > 1), bm AS (SELECT result_id, rep, avg(vs[1 + CAST(CAST('0x' || substr(md5(concat_ws('|', '4', result_id, rep, i)), 1, 8) AS BIGINT) % n AS BIGINT)]) AS m FROM bd GROUP BY 1, 2), ci AS (SELECT result_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY 1),
 fd AS (SELECT result_id, rep, seen, nv, vs, unnest(range(n)) AS i FROM a CROSS JOIN reps WHERE n > 1 AND tested), ft AS (SELECT result_id, rep, seen, sum(CASE WHEN CAST('0x' || substr(md5(concat_ws('|', '4', result_id, rep, i)), 1, 8) AS BIGINT) % 2 = 1 THEN vs[i + 1] - nv ELSE nv - vs[i + 1] END) AS t FROM fd GROUP BY 1, 2, 3), p AS (SELECT result_id, (count(*) FILTER (abs(t) >= seen - 1e-9) + 1) / (count(*) + 1) AS p FROM ft GROUP BY 1),
 j AS (SELECT s.*, coalesce(n, 0) AS n, mean, lo, hi, p, n_sessions, n_trials, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, result_id) AS k, count(p) OVER (PARTITION BY family) AS m FROM spec s LEFT JOIN a USING (result_id) LEFT JOIN ci USING (result_id) LEFT JOIN p USING (result_id)),
 h AS (SELECT *, CASE WHEN p IS NOT NULL THEN max(CASE WHEN p IS NOT NULL THEN least(1.0, (m - k + 1) * p) END) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING) END AS adj FROM j)
 SELECT result_id, metric, contrast_id, hypothesis, scale, tier, CASE WHEN n >= 2 THEN 'estimated' WHEN n = 1 THEN 'point_only' ELSE 'not_estimable' END AS status, CASE n WHEN 1 THEN 'one_unit' WHEN 0 THEN 'no_values' END AS status_reason, round(mean, 5) AS estimate, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high, CASE WHEN lo IS NOT NULL THEN 0.95 END AS confidence_level, CASE WHEN lo IS NOT NULL THEN 'percentile_bootstrap' END AS ci_method,
 null_value, round(p, 6) AS p_value, round(adj, 6) AS adjusted_p_value, CASE WHEN p IS NOT NULL THEN 'two_sided' END AS sidedness, CASE WHEN p IS NOT NULL THEN 'sign_flip_sampled' END AS test_method, CASE WHEN tested THEN family END AS multiplicity_family, CASE WHEN adj IS NOT NULL THEN 'holm' END AS multiplicity_method, n AS n_mice, CAST(n_sessions AS BIGINT) AS n_sessions, CAST(n_trials AS BIGINT) AS n_trials,
 CASE WHEN lo IS NOT NULL THEN 500 END AS n_bootstrap, CASE WHEN p IS NOT NULL THEN 500 END AS n_resamples, 4 AS seed, 'all orders' AS inclusion_definition, 'orders' AS source_table, notes FROM h"""


@query(_STATISTICS)
def statistics_rows(spark, sf_dir):
    """A statistics table from a specification: several results on one metric, other null values, families, one unit, no values."""
    base = estimates(spark, sf_dir).groupBy("segment", "subject").agg((F.avg("score") - 140).alias("v"), F.avg(F.col("response").cast("int")).alias("w"), F.countDistinct("source").alias("sessions"), F.count("*").alias("trials"))
    metric = lambda name, c: base.select(name.alias("metric"), "subject", F.col(c).alias("value"), "sessions", "trials")
    long = metric(F.concat(F.lit("score_"), F.col("segment")), "v").unionByName(metric(F.concat(F.lit("share_"), F.col("segment")), "w")).unionByName(base.where("subject = 0 and segment = 'BUILDING'").select(F.lit("one_nation").alias("metric"), "subject", F.col("w").alias("value"), "sessions", "trials"))
    out = I.specified_statistics(long, SPECIFICATION, counts={"n_sessions": "sessions", "n_trials": "trials"}, provenance={"inclusion_definition": "all orders", "source_table": "orders"}, seed=4, resamples=500, flips=500, exact_up_to=5)
    kept = [c for c in out.columns if c not in ("n_units", "model_formula", "data_version", "code_version", "config_hash")]
    return out.select(*[F.round(c, 5 if c in ("estimate", "ci_low", "ci_high") else 6).alias(c) if c in ("estimate", "ci_low", "ci_high", "p_value", "adjusted_p_value") else F.col(c) for c in kept])


_PERMUTED = lambda n: f"""x AS (SELECT source, subject, unit, region, weight, rep, row_number() OVER (PARTITION BY source, rep ORDER BY unit) AS a, row_number() OVER (PARTITION BY source, rep ORDER BY md5(concat_ws('|', '5', rep, source, unit)), unit) AS b FROM units CROSS JOIN (SELECT unnest(range({n})) AS rep)),
 d AS (SELECT l.source, l.subject, l.region, l.rep, v.weight FROM x l JOIN x v ON l.source = v.source AND l.rep = v.rep AND l.a = v.b), s AS (SELECT rep, region, subject, source, avg(weight) AS m FROM d GROUP BY 1, 2, 3, 4), t AS (SELECT rep, region, subject, avg(m) AS m FROM s GROUP BY 1, 2, 3),
 nul AS (SELECT region, rep, avg(m) AS mean FROM t GROUP BY 1, 2)"""  # noqa: E731


@query(f"""WITH {UNITS}, {_PERMUTED(100)}, one AS (SELECT region, subject, source, avg(weight) AS m FROM units GROUP BY 1, 2, 3), two AS (SELECT region, subject, avg(m) AS m FROM one GROUP BY 1, 2), seen AS (SELECT region, avg(m) AS observed FROM two GROUP BY 1),
 p AS (SELECT region, observed, (count(*) FILTER (abs(mean - centre) >= abs(observed - centre) - 1e-12) + 1) / (count(*) + 1) AS p_value FROM nul JOIN seen USING (region) JOIN (SELECT region, avg(mean) AS centre FROM nul GROUP BY 1) USING (region) GROUP BY region, observed),
 h AS (SELECT *, row_number() OVER (ORDER BY p_value, region) AS k, count(*) OVER () AS n FROM p), holm AS (SELECT *, max(least(1.0, (n - k + 1) * p_value)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS adjusted_p FROM h),
 a AS (SELECT region, count(*) AS n, list(m ORDER BY subject) AS vs, avg(m) AS mean FROM two GROUP BY 1), bd AS (SELECT region, rep, n, vs, unnest(range(n)) AS i FROM a CROSS JOIN (SELECT unnest(range(200)) AS rep)),
 bm AS (SELECT region, rep, avg(vs[1 + CAST(CAST('0x' || substr(md5(concat_ws('|', '0', region, rep, i)), 1, 8) AS BIGINT) % n AS BIGINT)]) AS m FROM bd GROUP BY 1, 2), ci AS (SELECT region, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY 1)
 SELECT region, a.n, round(a.mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(observed, 6) AS observed, round(p_value, 6) AS p_value, round(adjusted_p, 6) AS adjusted_p, CAST(row_number() OVER (ORDER BY a.mean DESC, region) AS INT) AS rank, row_number() OVER (ORDER BY a.mean DESC, region) = 1 AS is_lead,
 CASE WHEN a.mean > 0 AND ci_low > 0 AND adjusted_p < 0.05 THEN 'pass' WHEN a.mean > 0 AND ci_low > 0 THEN 'fragile' ELSE 'null' END AS screen_status FROM a JOIN ci USING (region) JOIN holm USING (region)""")
def nominated_regions(spark, sf_dir):
    """Permutation test of regions' mean weight, adjusted and ranked."""
    u = units(spark, sf_dir)
    test = I.permutation_test(u, session="source", subject="subject", unit="unit", label="region", value="weight", permutations=100, seed=5)
    boot = I.bootstrap_mean(Z.equal_weight_means(u, ["weight"], by=["region", "subject"]), by=["region"], unit="subject", value="weight", resamples=200)
    return I.nominate(boot.join(test, "region"), order=["region"]).select("region", "n", *r("mean", "ci_low", "ci_high", "observed", "p_value", "adjusted_p"), "rank", "is_lead", "screen_status")


# --- cohorts and models --------------------------------------------------------------------------


def allocation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as subjects: region as a category, and numbers of their customers."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    s = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region")).agg(F.count("*").alias("customers"), F.floor(F.avg("c_acctbal")).alias("balance"))
    return C.subject_features(s, subject="nation", categories=["region"], numbers=["customers", "balance"])


_SPLITS = """subj AS (SELECT c_nationkey AS nation, any_value(n_regionkey) AS region, count(*) AS customers, CAST(floor(avg(c_acctbal)) AS BIGINT) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
feats AS (SELECT nation::VARCHAR AS nation, 'region' AS family, 'region=' || g.region AS feature, CAST(subj.region = g.region AS BIGINT) AS value FROM subj CROSS JOIN (SELECT DISTINCT region FROM subj) g UNION ALL SELECT nation::VARCHAR, 'numeric', 'customers', customers FROM subj UNION ALL SELECT nation::VARCHAR, 'numeric', 'balance', balance FROM subj),
stats AS (SELECT family, feature, count(*) AS n, sum(value)::DOUBLE AS s, avg(value) AS mean, var_samp(value) AS v FROM feats GROUP BY 1, 2 HAVING var_samp(value) > 0),
combos AS (SELECT a.nation AS a, b.nation AS b, c.nation AS c, d.nation AS d FROM (SELECT DISTINCT nation FROM feats) a JOIN (SELECT DISTINCT nation FROM feats) b ON b.nation > a.nation JOIN (SELECT DISTINCT nation FROM feats) c ON c.nation > b.nation JOIN (SELECT DISTINCT nation FROM feats) d ON d.nation > c.nation),
named AS (SELECT concat_ws(',', a, b, c, d) AS members, unnest([a, b, c, d]) AS nation FROM combos),
smd AS (SELECT members, f.family, f.feature, pow(sum(value) / 4 - (any_value(s) - sum(value)) / (any_value(t.n) - 4), 2) / any_value(v) AS d FROM named JOIN feats f USING (nation) JOIN stats t ON t.feature = f.feature AND t.family = f.family GROUP BY 1, 2, 3),
obj AS (SELECT members, round(avg(m), 12) AS objective, round(max(w), 12) AS worst FROM (SELECT members, family, avg(d) AS m, max(d) AS w FROM smd GROUP BY 1, 2) GROUP BY 1),
best AS (SELECT *, count(*) OVER () AS n_candidates, count(*) OVER (PARTITION BY objective) AS n_tied, count(*) OVER (PARTITION BY objective, worst) AS n_tied_twice FROM obj QUALIFY row_number() OVER (ORDER BY objective, worst, sha256('20240101|' || members), members) = 1)"""


@query(f"WITH {_SPLITS} SELECT members, round(objective, 8) AS objective, round(worst, 8) AS worst, n_candidates, n_tied, n_tied_twice FROM best")
def cohort_allocation(spark, sf_dir):
    return C.allocate(allocation_features(spark, sf_dir), C.AllocationConfig(confirmation=4), subject="nation").select(F.array_join("members", ",").alias("members"), *r("objective", "worst", digits=8), "n_candidates", "n_tied", "n_tied_twice")


@query(f"""WITH {_SPLITS}, inside AS (SELECT unnest(string_split(members, ',')) AS nation FROM best) SELECT f.family, f.feature, round(avg(value) FILTER (i.nation IS NOT NULL), 6) AS mean_confirmation, round(avg(value) FILTER (i.nation IS NULL), 6) AS mean_discovery,
 round((avg(value) FILTER (i.nation IS NULL) - avg(value) FILTER (i.nation IS NOT NULL)) / sqrt(var_samp(value)), 6) AS smd FROM feats f JOIN stats USING (family, feature) LEFT JOIN inside i ON i.nation = f.nation GROUP BY 1, 2""")
def cohort_balance(spark, sf_dir):
    features = allocation_features(spark, sf_dir)
    out = C.balance_table(features, C.allocate(features, C.AllocationConfig(confirmation=4), subject="nation"), subject="nation")
    return out.select("family", "feature", *r("mean_confirmation", "mean_discovery", "smd"))


@query("""WITH s AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 97 = 0 THEN ' ' ELSE 'n' || c_nationkey END AS subject, n_regionkey AS region, CASE WHEN c_custkey % 211 = 0 THEN NULL WHEN c_custkey % 311 = 0 THEN 'other' ELSE 'n' END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey),
 q AS (SELECT c_custkey AS session, 'n' || c_nationkey AS subject, CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE c_acctbal > 0 END AS is_good_session FROM customer WHERE c_custkey % 53 <> 0 UNION ALL SELECT c_custkey, 'n' || c_nationkey, true FROM customer WHERE c_custkey % 149 = 0)
 SELECT 'unique_session' AS rule, 0::BIGINT AS n_violations UNION ALL SELECT 'unique_quality_session', count(*) - count(DISTINCT session) FROM q UNION ALL SELECT 'named_subject', count(*) FILTER (trim(subject) = '') FROM s UNION ALL SELECT 'known_region', count(*) FILTER (region IS NULL) FROM s
 UNION ALL SELECT 'known_kind', count(*) FILTER (kind IS NULL) FROM s UNION ALL SELECT 'named_quality_subject', count(*) FILTER (trim(subject) = '') FROM q UNION ALL SELECT 'known_selection', count(*) FILTER (is_good_session IS NULL) FROM q
 UNION ALL SELECT 'same_sessions', (SELECT count(*) FROM (SELECT session FROM s EXCEPT SELECT session FROM q)) + (SELECT count(*) FROM (SELECT session FROM q EXCEPT SELECT session FROM s))
 UNION ALL SELECT 'same_subjects', (SELECT count(*) FROM (SELECT session, subject FROM s EXCEPT SELECT session, subject FROM q)) + (SELECT count(*) FROM (SELECT session, subject FROM q EXCEPT SELECT session, subject FROM s))
 UNION ALL SELECT 'constant_metadata', count(*) FROM (SELECT subject FROM s GROUP BY 1 HAVING count(DISTINCT region) + max(CAST(region IS NULL AS INT)) > 1 OR count(DISTINCT kind) + max(CAST(kind IS NULL AS INT)) > 1)
 UNION ALL SELECT 'eligible_subjects', abs(count(DISTINCT subject) - 20) FROM q WHERE is_good_session""")
def allocation_input_rules(spark, sf_dir):
    """What an allocation would refuse, on customers as sessions with defects of every kind."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key, own = F.col("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey"))
    sessions = c.select(key.alias("session"), F.when(key % 97 == 0, " ").otherwise(own).alias("subject"), F.col("n_regionkey").alias("region"), F.when(key % 211 == 0, F.lit(None)).when(key % 311 == 0, "other").otherwise("n").alias("kind"))
    quality = c.where(key % 53 != 0).select(key.alias("session"), own.alias("subject"), F.when(key % 89 != 0, F.col("c_acctbal") > 0).alias("is_good_session")).unionByName(c.where(key % 149 == 0).select(key.alias("session"), own.alias("subject"), F.lit(True).alias("is_good_session")))
    return C.input_violations(sessions, quality, session="session", subject="subject", constant=["region", "kind"], subjects=20)


def _fit_parts(spark, sf_dir):
    """Partitions of fits by session: one for about 50,000 events."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_of(table(spark, sf_dir, "events"), 50_000))


@query()
def reward_state_axis(spark, sf_dir):
    """A cross-validated axis per session on features of range-joined counts."""
    events = Z.with_condition(labelled(spark, sf_dir))
    counts = J.count_in_windows(spikes(spark, sf_dir), events, by=["source"], point="t", event="change_time", windows={"before": (-43200.0, 0.0), "after": (0.0, 43200.0)}, unit=["unit"], event_key=["id", "reward_block", "change_time"])
    f = counts.select("source", F.col("id").alias("event"), F.col("change_time").alias("time"), "reward_block", "unit", (stabilized(F.col("after")) - stabilized(F.col("before"))).alias("value"))
    # another number than that of shuffles, or Spark takes the dealing for one of its own and merges small partitions
    parts = _fit_parts(spark, sf_dir)
    return A.state_axis(f, parts=parts + (parts == int(spark.conf.get("spark.sql.shuffle.partitions"))))


@query()
def block_ridge(spark, sf_dir):
    """Nested ridge per subject from moments by fold."""
    e = estimates(spark, sf_dir).withColumns({"time": F.unix_micros(F.col("placed").cast("timestamp")) / 1e12, "image": F.col("status")})
    design = M.model_design(B.contiguous_folds(e, 3, by=["subject", "reward_block"], order=["placed", "id"]), source="subject", images=["F", "O", "P"], response="response")
    return M.nested_ridge(M.moments(design, [f"x{i}" for i in range(7)], "score", by=["subject", "fold"]), by=["subject"], folds=3)


@query()
def network_pairs(spark, sf_dir):
    """What counts of two event types add to the prediction of those of two others, per session and block."""
    t = N.trial_covariates(Z.with_condition(labelled(spark, sf_dir)).withColumn("latency", F.when(F.col("response"), F.col("value") / 100)), by=["source"], image="event_type", latency="latency")
    windows = {"before": (-86400.0, 0.0), "early": (0.0, 43200.0), "late": (43200.0, 86400.0)}
    counts = J.count_in_windows(spikes(spark, sf_dir), t, by=["source"], point="t", event="change_time", windows=windows, unit=["unit"], event_key=["id", "change_time", "reward_block", "nuisance"])
    of = lambda u, w: F.coalesce(F.max(F.when(F.col("unit") == u, stabilized(F.col(w)) - stabilized(F.col("before")))), F.lit(0.0))
    sides = lambda w, *us: F.array(*[of(u, w) for u in us])
    rows = counts.groupBy("source", F.col("change_time").alias("time"), "id", "reward_block").agg(sides("early", "view", "click").alias("source_values"), F.concat(F.first("nuisance"), sides("early", "purchase", "error")).alias("base_values"), sides("late", "purchase", "error").alias("target_values"))
    # explicit, as the fits of a partition take far longer than its few bytes suggest
    rows = rows.repartition(_fit_parts(spark, sf_dir), "source")
    return N.network_by_block(rows, N.NetworkConfig(min_units=2), by=["source"]).drop("folds")


@query(f"""WITH {TRIALS}, w AS (SELECT source, min(CASE WHEN reward_block = 'engaged_1' THEN start_time END) AS a, max(CASE WHEN reward_block = 'engaged_1' THEN stop_time END) AS b, min(CASE WHEN reward_block = 'engaged_2' THEN start_time END) AS c, max(CASE WHEN reward_block = 'engaged_2' THEN stop_time END) - {DAY} AS d FROM labelled GROUP BY 1),
 k AS (SELECT source, event_type AS unit, any_value(b > a AND d > c) AS ok, count(*) FILTER (start_time >= a AND start_time < b) / any_value(b - a) AS r1, count(*) FILTER (start_time >= c AND start_time < d) / any_value(d - c) AS r2 FROM trials JOIN w USING (source) GROUP BY 1, 2)
 SELECT source, unit, CASE WHEN greatest(r1, r2) > 0 THEN round(least(r1, r2) / greatest(r1, r2), 5) END AS rate_ratio, CASE WHEN greatest(r1, r2) = 0 THEN 'silent' WHEN least(r1, r2) / greatest(r1, r2) < 0.5 THEN 'unstable' ELSE 'stable' END AS stability FROM k WHERE ok""")
def rate_stability(spark, sf_dir):
    windows = B.block_windows(labelled(spark, sf_dir), tail=DAY)
    return Z.rate_stability(spike_arrays(spark, sf_dir), windows).where("stability <> 'no_windows'").select("source", "unit", *r("rate_ratio", digits=5), "stability")


@query(f"WITH {ESTIMATES} SELECT segment, arg_max(status, k) AS status, max(n) AS n FROM (SELECT segment, status, count(*) AS n, count(*) * 1000 + ascii(status) AS k FROM estimates GROUP BY 1, 2) GROUP BY 1")
def dominant_status(spark, sf_dir):
    return Z.dominant_labels(estimates(spark, sf_dir), by=["segment"], label="status")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_gating(spark, sf_dir)


from . import panels, reads_and_audits, studies  # noqa: E402, F401  they register their own
