"""Registered queries of figures' source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reversible
from ..operators import blocks as B
from ..operators import inference as I
from ..operators import panels as PN
from .registry import query, r
from .studies import _ANCHORS, score_tables
from .views import DAY, ESTIMATES, TRIALS, UNITS, estimates, labelled, units

# --- blocks of subjects ------------------------------------------------------------------------

_DATED = f"{ESTIMATES}, est AS (SELECT * REPLACE (CASE WHEN year(placed) <= 1996 THEN 'engaged_1' WHEN year(placed) <= 1998 THEN 'no_reward' ELSE 'engaged_2' END AS reward_block) FROM estimates)"
_BLOCKS = f"""{_DATED}, sb AS (SELECT subject, source, reward_block, avg(score) AS v FROM est GROUP BY 1, 2, 3), sc AS (SELECT subject, source, 0.5 * max(v) FILTER (reward_block = 'engaged_1') - max(v) FILTER (reward_block = 'no_reward') + 0.5 * max(v) FILTER (reward_block = 'engaged_2') AS c FROM sb GROUP BY 1, 2),
blocks AS (SELECT sb.subject, reward_block, avg(v) AS v, count(*) AS n FROM sb JOIN sc USING (subject, source) WHERE subject % 2 = 1 OR c IS NOT NULL GROUP BY 1, 2), con AS (SELECT subject, avg(c) + CASE WHEN subject % 6 = 0 THEN 1 ELSE 0 END AS c, count(c) AS m FROM sc WHERE subject % 8 <> 2 GROUP BY subject)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials with blocks of two years."""
    year = F.year("placed")
    return estimates(spark, sf_dir).withColumn("reward_block", F.when(year <= 1996, "engaged_1").when(year <= 1998, "no_reward").otherwise("engaged_2"))


def block_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects' block means, of their complete sessions only for even subjects, beside contrasts that are wrong for every sixth."""
    sessions = dated(spark, sf_dir).groupBy("subject", "source", "reward_block").agg(F.avg("score").alias("v"))
    of = lambda b: F.max(F.when(F.col("reward_block") == b, F.col("v")))
    each = sessions.groupBy("subject", "source").agg(reversible(*map(of, PN.BLOCKS)).alias("c"))
    blocks = sessions.join(each, ["subject", "source"]).where("subject % 2 = 1 or c is not null").groupBy("subject", "reward_block").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    contrasts = each.where("subject % 8 <> 2").groupBy("subject").agg((F.avg("c") + F.when(F.col("subject") % 6 == 0, 1).otherwise(0)).alias("c"), F.count("c").alias("m"))
    return PN.connected_blocks(blocks, contrasts, subject="subject", block="reward_block", value="v", sessions="n", contrast="c", contrast_sessions="m")


@query(f"""WITH {_BLOCKS}, w AS (SELECT subject, max(v) FILTER (reward_block = 'engaged_1') AS a, max(v) FILTER (reward_block = 'no_reward') AS b, max(v) FILTER (reward_block = 'engaged_2') AS d, min(n) AS lo, max(n) AS hi, count(*) AS k FROM blocks GROUP BY 1),
 j AS (SELECT w.subject, coalesce(k = 3 AND lo = m AND hi = m AND c IS NOT NULL, false) AS ok, 0.5 * a - b + 0.5 * d AS made, c FROM w LEFT JOIN con USING (subject))
 SELECT subject, reward_block, round(v, 6) AS v, n, ok AS is_connected, round(CASE WHEN ok THEN made END, 6) AS reconstructed, round(CASE WHEN ok THEN c - made END, 6) AS difference FROM blocks JOIN j USING (subject)""")
def block_panel_rows(spark, sf_dir):
    """Which subjects' block means a line may join, and where the stored contrast isn't what they give."""
    return block_panel(spark, sf_dir).select("subject", "reward_block", *r("v"), "n", "is_connected", *r("reconstructed", "difference"))


_BOOT = lambda rows, keys, n=100: f"""a AS (SELECT {keys}, count(*) AS n, list(v ORDER BY subject) AS vs, avg(v) AS mean FROM ({rows}) GROUP BY ALL), bd AS (SELECT {keys}, rep, n, vs, unnest(range(n)) AS i FROM a CROSS JOIN (SELECT unnest(range({n})) AS rep) WHERE n > 1),
 bm AS (SELECT {keys}, rep, avg(vs[1 + CAST(CAST('0x' || substr(md5(concat_ws('|', '9', {keys}, rep, i)), 1, 8) AS BIGINT) % n AS BIGINT)]) AS m FROM bd GROUP BY ALL), ci AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY ALL)"""  # noqa: E731


@query(f"""WITH {_BLOCKS}, {_BOOT('SELECT reward_block, subject, v FROM blocks', 'reward_block')} SELECT a.reward_block, a.n, round(mean, 5) AS mean, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high, CAST(t.s AS BIGINT) AS n_sessions FROM a JOIN ci USING (reward_block) JOIN (SELECT reward_block, sum(n) AS s FROM blocks GROUP BY 1) t USING (reward_block)""")
def block_panel_summary(spark, sf_dir):
    panel = block_panel(spark, sf_dir).select("subject", "reward_block", "v", F.col("n").alias("n_sessions"))
    return PN.panel_summary(panel, by=["reward_block"], subject="subject", value="v", seed=9, resamples=100, counts=["n_sessions"]).select("reward_block", "n", *r("mean", "ci_low", "ci_high", digits=5), "n_sessions")


@query(f"""WITH {_BLOCKS}, p AS (SELECT reward_block AS key, avg(v) AS mean, count(*) AS n FROM blocks WHERE reward_block <> 'engaged_2' GROUP BY 1), s AS (SELECT reward_block AS key, avg(v) + CASE reward_block WHEN 'no_reward' THEN 0.01 ELSE 0 END AS estimate, count(*) + CASE reward_block WHEN 'engaged_1' THEN 1 ELSE 0 END AS n_mice FROM blocks GROUP BY 1 UNION ALL SELECT 'other', 1.0, 2)
 SELECT coalesce(p.key, s.key) AS key, CASE WHEN p.key IS NULL THEN 'not_drawn' WHEN s.key IS NULL THEN 'no_statistic' WHEN n_mice <> n THEN 'other_n' ELSE 'other_estimate' END AS problem FROM p FULL JOIN s ON p.key = s.key WHERE p.key IS NULL OR s.key IS NULL OR n_mice <> n OR abs(estimate - mean) > 1e-9 * greatest(1, abs(mean))""")
def panel_problems(spark, sf_dir):
    """Statistics that don't agree with what is drawn: one of each kind."""
    means = block_panel(spark, sf_dir).groupBy(F.col("reward_block").alias("key")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    stated = means.select("key", (F.col("mean") + F.when(F.col("key") == "no_reward", 0.01).otherwise(0)).alias("estimate"), (F.col("n") + F.when(F.col("key") == "engaged_1", 1).otherwise(0)).alias("n_mice"))
    other = means.limit(1).select(F.lit("other").alias("key"), F.lit(1.0).alias("estimate"), F.lit(2).cast("bigint").alias("n_mice"))
    return PN.panel_mismatches(stated.unionByName(other), means.where("key <> 'engaged_2'"), key="key")


@query(f"""WITH {TRIALS}, b AS (SELECT source, reward_block, min(start_time) AS s, max(stop_time) AS e FROM labelled GROUP BY 1, 2), f AS (SELECT source, min(start_time) AS z FROM labelled GROUP BY 1)
 SELECT reward_block, count(*) AS n_sessions, {', '.join(f"round(quantile_cont({x}, {q}), 3) AS {n}_q{int(q * 100)}" for n, x in (('offset', 's - z'), ('duration', 'e - s')) for q in (0.25, 0.5, 0.75))} FROM b JOIN f USING (source) GROUP BY 1""")
def block_timing_quartiles(spark, sf_dir):
    out = PN.timing_quartiles(B.block_timing(labelled(spark, sf_dir)), by=["reward_block"], values=["offset", "duration"])
    return out.select("reward_block", "n_sessions", *[F.round(c, 3).alias(c) for c in out.columns[2:]])


# --- trajectories, leads and pairs -------------------------------------------------------------

_TRAJECTORY = f"""{_ANCHORS}, per AS (SELECT source, subject, transition, anchor, CAST(floor(rel / {DAY}) AS INT) AS bin, count(*) AS n, avg(s) AS m FROM near WHERE floor(rel / {DAY}) BETWEEN -5 AND 4 GROUP BY ALL), subj AS (SELECT subject, transition, bin, avg(m) AS v, CAST(sum(n) AS BIGINT) AS n_trials FROM per WHERE anchor = 'real' GROUP BY 1, 2, 3)"""


@query(f"""WITH {_TRAJECTORY}, {_BOOT('SELECT transition, bin, subject, v FROM subj', 'transition, bin', 60)} SELECT transition, bin, bin * {DAY / 60} AS bin_start_minutes, a.n, round(mean, 5) AS mean, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high, CAST(t.k AS BIGINT) AS n_trials FROM a LEFT JOIN ci USING (transition, bin) JOIN (SELECT transition, bin, sum(n_trials) AS k FROM subj GROUP BY 1, 2) t USING (transition, bin)""")
def trajectory_panel(spark, sf_dir):
    """Scores around real boundaries with intervals over subjects, on a grid that has to be complete, in minutes."""
    tables = score_tables(spark, sf_dir)
    real = tables.subject_trajectories.where("anchor = 'real'").select("subject", "transition", "bin", "bin_start", F.col("mean_score").alias("v"), "n_trials")
    panel = PN.panel_summary(real, by=["transition", "bin"], subject="subject", value="v", seed=9, resamples=60, counts=["n_trials"])
    grid = tables.session_trajectories.select("transition", "bin").distinct()
    panel = PN.complete_rows(panel, grid, keys=["transition", "bin"]).withColumn("bin_start", F.col("bin") * DAY)
    return PN.in_minutes(panel, ["bin_start"]).select("transition", "bin", "bin_start_minutes", "n", *r("mean", "ci_low", "ci_high", digits=5), "n_trials")


@query(f"""WITH {UNITS}, x AS (SELECT source, subject, unit, region, weight, rep, row_number() OVER (PARTITION BY source, rep ORDER BY unit) AS a, row_number() OVER (PARTITION BY source, rep ORDER BY md5(concat_ws('|', '5', rep, source, unit)), unit) AS b FROM units CROSS JOIN (SELECT unnest(range(40)) AS rep)),
 d AS (SELECT l.source, l.subject, l.region, l.rep, v.weight FROM x l JOIN x v ON l.source = v.source AND l.rep = v.rep AND l.a = v.b), t AS (SELECT rep, region, subject, avg(m) AS m FROM (SELECT rep, region, subject, source, avg(weight) AS m FROM d GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 lead_region AS (SELECT region FROM (SELECT region, subject, avg(m) AS m FROM (SELECT region, subject, source, avg(weight) AS m FROM units GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1 ORDER BY avg(m) DESC, region LIMIT 1) SELECT region, rep, round(avg(m), 8) AS mean FROM t JOIN lead_region USING (region) GROUP BY 1, 2""")
def lead_region_null(spark, sf_dir):
    """The permuted means of the region with the highest mean weight."""
    u = units(spark, sf_dir)
    null = I.permutation_null(u, session="source", subject="subject", unit="unit", label="region", value="weight", permutations=40, seed=5)
    means = u.groupBy("region", "subject", "source").agg(F.avg("weight").alias("m")).groupBy("region", "subject").agg(F.avg("m").alias("m")).groupBy("region").agg(F.avg("m").alias("m"))
    best = means.agg(F.min(F.struct((-F.col("m")).alias("m"), "region")).alias("b")).select(F.col("b.region").alias("region"), F.lit(True).alias("is_lead"))
    return PN.lead_null(null, best, label="region").withColumn("mean", F.round("mean", 8))


@query(f"""WITH {_DATED}, b AS (SELECT subject, reward_block, avg(sqrt(score)) AS v FROM est WHERE segment = 'BUILDING' AND status = 'F' GROUP BY 1, 2), w AS (SELECT subject, max(v) FILTER (reward_block = 'engaged_1') AS engaged_1, max(v) FILTER (reward_block = 'no_reward') AS no_reward, max(v) FILTER (reward_block = 'engaged_2') AS engaged_2 FROM b GROUP BY 1)
 SELECT subject, round(engaged_1, 6) AS engaged_1, round(no_reward, 6) AS no_reward, round(engaged_2, 6) AS engaged_2, round(0.5 * engaged_1 - no_reward + 0.5 * engaged_2, 6) AS contrast FROM w WHERE engaged_1 + no_reward + engaged_2 IS NOT NULL""")
def pair_panel(spark, sf_dir):
    """Block values of one ordered pair (a segment and a status) by subject, with the contrast computed anew."""
    blocks = dated(spark, sf_dir).groupBy("subject", F.col("segment").alias("source_region"), F.col("status").alias("target_region"), "reward_block").agg(F.avg(F.sqrt("score")).alias("v"))
    out = PN.pair_panel(blocks, source_region="BUILDING", target_region="F", subject="subject", block="reward_block", value="v")
    return out.select("subject", *r(*PN.BLOCKS, "contrast"))
