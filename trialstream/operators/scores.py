"""Scores of trials around block transitions: trajectories over bins, steps at real and pseudo boundaries, and their contrasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import is_finite


@dataclass(frozen=True)
class ScoreConfig:
    trajectory_window: float = 360.0
    bin_width: float = 120.0
    effect_window: float = 360.0
    #: Trials on each side of an anchor that a step needs.
    min_trials: int = 5


@dataclass(frozen=True)
class ScoreTables:
    session_trajectories: DataFrame
    subject_trajectories: DataFrame
    session_steps: DataFrame
    subject_steps: DataFrame
    session_contrasts: DataFrame
    subject_contrasts: DataFrame


def score_anchors(boundaries: DataFrame, *, source: str, subject: str, included: str | None = None, pseudo_block: str = "pre_block") -> DataFrame:
    """Two rows, real and pseudo, for each session and transition: anchor_time (null if it isn't finite or the session isn't included) and the block before and after it.

    A session and transition with several rows is an error.
    """
    several = F.count("*").over(Window.partitionBy(source, "transition")) > 1
    once = F.when(several, F.raise_error(F.concat(F.lit("several boundaries of one session and transition: "), F.col(source).cast("string"), F.lit(" "), F.col("transition")))).otherwise(F.col("transition"))
    # counted before a boundary becomes two rows
    boundaries = boundaries.withColumn("transition", once)
    use = F.lit(True) if included is None else F.coalesce(F.col(included), F.lit(False))
    time = lambda c: F.when(use & is_finite(c), F.col(c).cast("double")).alias("anchor_time")
    real = F.struct(F.lit("real").alias("anchor"), time("real_time"), F.col("pre_block").alias("before_block"), F.col("post_block").alias("after_block"))
    pseudo = F.struct(F.lit("pseudo").alias("anchor"), time("pseudo_time"), F.col(pseudo_block).alias("before_block"), F.col(pseudo_block).alias("after_block"))
    return boundaries.select(source, subject, "transition", F.col("direction").cast("double").alias("direction"), F.explode(F.array(real, pseudo)).alias("a")).select(source, subject, "transition", "direction", "a.*")


def transition_scores(scores: DataFrame, boundaries: DataFrame, config: ScoreConfig = ScoreConfig(), *, source: str = "source", subject: str = "subject", time: str = "change_time", block: str = "reward_block", score: str = "score", included: str | None = None, pseudo_block: str = "pre_block") -> ScoreTables:
    """Tables of scores around the anchors of boundaries (as transition_boundaries makes them), by session and by subject.

    A trial counts before an anchor if it has the block before it, and from the anchor on if it has the block after it; others, of the wrong state, don't count, nor do
    trials without a finite time and score. trajectories: half-open bins over a complete grid, with status pass, no_trials or invalid_boundary. steps:
    direction * (mean after - mean before) within the effect window, null with under min_trials on a side (insufficient_trials). contrasts: real less pseudo step.
    Subjects' rows are means over their sessions' rows that pass, each session weighing the same.
    """
    marks = score_anchors(boundaries, source=source, subject=subject, included=included, pseudo_block=pseudo_block)
    keys = [source, subject, "transition", "anchor"]
    own = scores.where(is_finite(time) & is_finite(score)).select(source, F.col(time).cast("double").alias("_t"), F.col(block).alias("_b"), F.col(score).cast("double").alias("_s"))
    near = own.join(marks.where(F.col("anchor_time").isNotNull()), source).withColumn("_rel", F.col("_t") - F.col("anchor_time"))
    near = near.where(F.col("_b") == F.when(F.col("_rel") < 0, F.col("before_block")).otherwise(F.col("after_block")))

    side = int(config.trajectory_window / config.bin_width)
    width = F.lit(config.bin_width)
    guess = F.floor(F.col("_rel") / width)
    at = F.when(F.col("_rel") < guess * width, guess - 1).when(F.col("_rel") >= (guess + 1) * width, guess + 1).otherwise(guess).cast("int")
    found = near.withColumn("bin", at).where(F.col("bin").between(-side, side - 1)).groupBy(*keys, "bin").agg(F.count("*").alias("n_trials"), F.avg("_s").alias("mean_score"))
    grid = marks.withColumn("bin", F.explode(F.sequence(F.lit(-side), F.lit(side - 1)))).withColumns({"expected_block": F.when(F.col("bin") < 0, F.col("before_block")).otherwise(F.col("after_block")), "bin_start": F.col("bin") * width, "bin_stop": (F.col("bin") + 1) * width, "bin_center": (F.col("bin") + 0.5) * width})
    trajectories = grid.join(found, [*keys, "bin"], "left").fillna(0, ["n_trials"])
    status = F.when(F.col("anchor_time").isNull(), "invalid_boundary").when(F.col("n_trials") == 0, "no_trials").otherwise("pass")
    trajectories = trajectories.select(*keys, "bin", "bin_start", "bin_stop", "bin_center", "expected_block", "n_trials", "mean_score", status.alias("status"))

    of = lambda before, f: f(F.when((F.col("_rel") < 0) if before else (F.col("_rel") >= 0), F.col("_s")))
    around = near.where((F.col("_rel") >= -config.effect_window) & (F.col("_rel") < config.effect_window))
    sides = around.groupBy(*keys).agg(of(True, F.count).alias("n_pre"), of(False, F.count).alias("n_post"), of(True, F.avg).alias("pre_mean"), of(False, F.avg).alias("post_mean"))
    steps = marks.join(sides, keys, "left").fillna(0, ["n_pre", "n_post"])
    enough = F.least("n_pre", "n_post") >= config.min_trials
    steps = steps.withColumns({"signed_step": F.when(enough, F.col("direction") * (F.col("post_mean") - F.col("pre_mean"))), "status": F.when(F.col("anchor_time").isNull(), "invalid_boundary").when(enough, "pass").otherwise("insufficient_trials")})

    step = lambda a, c: F.max(F.when(F.col("anchor") == a, F.col(c)))
    contrasts = steps.groupBy(source, subject, "transition").agg(*[step(a, "signed_step").alias(f"{a}_step") for a in ("real", "pseudo")], *[step(a, f"n_{s}").alias(f"n_{a}_{s}") for a in ("real", "pseudo") for s in ("pre", "post")])
    contrasts = contrasts.withColumn("real_minus_pseudo", F.col("real_step") - F.col("pseudo_step"))
    contrasts = contrasts.withColumn("status", F.when(F.col("real_minus_pseudo").isNotNull(), "pass").otherwise("insufficient_anchor_support"))

    good = lambda df: df.where("status = 'pass'")
    n = F.count("*").alias("n_sessions")
    return ScoreTables(
        trajectories,
        good(trajectories).groupBy(subject, "transition", "anchor", "bin", "bin_start", "bin_stop", "bin_center").agg(n, F.sum("n_trials").alias("n_trials"), F.avg("mean_score").alias("mean_score")),
        steps,
        good(steps).groupBy(subject, "transition", "anchor").agg(n, F.sum("n_pre").alias("n_pre"), F.sum("n_post").alias("n_post"), F.avg("signed_step").alias("signed_step")),
        contrasts,
        good(contrasts).groupBy(subject, "transition").agg(n, F.avg("real_minus_pseudo").alias("real_minus_pseudo")),
    )
