"""Joins: with declared cardinality, by time, by nearest sample, by searched offset, and along a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Events whose pairs and counts one partition of a range join holds, about.
EVENTS_IN_PART = 50_000


class CardinalityError(ValueError):
    """A key that must be unique isn't, or null."""


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """left joined with right; raises CardinalityError if a side that validate (1:1, m:1, 1:m, m:m) calls unique isn't.

    The check is one aggregate over the keys of that side.
    """
    one_left, one_right = (side == "1" for side in validate.split(":"))
    for name, df, unique in (("left", left, one_left), ("right", right, one_right)):
        if unique and not (bad := repeated_keys(df.dropna(subset=on), on)).isEmpty():
            raise CardinalityError(f"{validate} join: the {name} side repeats keys such as {bad.first().asDict()}")
    return left.join(right, on, how)


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys that one side has and the other lacks: on, side."""
    a, b = left.select(*on).distinct().withColumn("_l", F.lit(True)), right.select(*on).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, on, "full_outer")
    return both.where("_l is null or _r is null").select(*on, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def fill_flag(primary: DataFrame, companion: DataFrame, on: list[str], flag: str, companion_flag: str, conflict: str | None = None) -> DataFrame:
    """primary with its flag filled from companion (m:1), flag_source (primary, companion, missing) and flag_conflict.

    A conflict needs both flags; where companion names a conflict column, its conflicting rows don't fill.
    """
    own = companion.select(*on, F.col(companion_flag).alias("_flag"), (F.coalesce(F.col(conflict), F.lit(False)) if conflict else F.lit(False)).alias("_bad"))
    joined = join_checked(primary, own, on, "left", "m:1")
    other = F.when(~F.coalesce("_bad", F.lit(False)), F.col("_flag"))
    return joined.withColumns({
        "flag_source": F.when(F.col(flag).isNotNull(), "primary").when(other.isNotNull(), "companion").otherwise("missing"),
        "flag_conflict": F.coalesce(F.col(flag) != other, F.lit(False)),
        flag: F.coalesce(F.col(flag), other),
    }).drop("_flag", "_bad")


def nearest(events: DataFrame, samples: DataFrame, *, by: list[str], time: str, sample_time: str, value: str, tolerance: float, offset: float = 0.0, name: str = "nearest") -> DataFrame:
    """events with the value of the sample nearest to time + offset, null if none is within tolerance; ties take the earlier.

    Events and samples are united and sorted once within each key; previous and next samples come from windows. Samples
    that aren't finite must be left out before; of equal times the greatest value counts.
    """
    own = events.withColumn("_t", F.col(time) + offset).withColumn("_row", F.monotonically_increasing_id())
    single = samples.groupBy(*by, F.col(sample_time).alias("_t")).agg(F.max(value).alias("_v"))
    both = own.select(*by, "_t", "_row", F.lit(None).cast("double").alias("_v"), F.lit(None).cast("double").alias("_s")).unionByName(single.select(*by, "_t", F.lit(None).cast("bigint").alias("_row"), F.col("_v").cast("double").alias("_v"), F.col("_t").cast("double").alias("_s")))
    order = Window.partitionBy(*by).orderBy("_t", F.col("_row").asc_nulls_first())
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    found = both.select("_row", "_t", *[F.last(c, ignorenulls=True).over(back).alias(f"{c}0") for c in ("_v", "_s")], *[F.first(c, ignorenulls=True).over(ahead).alias(f"{c}1") for c in ("_v", "_s")]).where("_row is not null")
    before, after = F.col("_t") - F.col("_s0"), F.col("_s1") - F.col("_t")
    earlier = before.isNotNull() & (after.isNull() | (before <= after))
    picked = F.when(earlier & (before <= tolerance), F.col("_v0")).when(~earlier & (after <= tolerance), F.col("_v1"))
    return own.join(found.select("_row", picked.alias(name)), "_row", "left").drop("_row", "_t")


def _pairs(points: DataFrame, events: DataFrame, *, by: list[str], point: str, event: str, low: float, high: float, unit: list[str], event_key: list[str]) -> DataFrame:
    """(by, _b, event_key, _e, unit, _p): events with the points within [event + low, event + high), and with a null point for each unit of their key.

    A bucketed range join: an event lies in one bucket, as wide as the window, and a point goes to the two or three whose events it can meet, so the join is on equal
    keys and spreads over time. All pairs of an event are in one bucket, so groupings by it that name _b need no exchange. Events are counted first: partitions
    grow in number with them, not in size.
    """
    width = high - low
    parts = -(-events.count() // EVENTS_IN_PART) or 1
    own = events.select(*by, *event_key, F.col(event).alias("_e"), F.coalesce(F.floor(F.col(event) / width), F.lit(0)).alias("_b"))
    dots = points.select(*by, *unit, F.col(point).alias("_p"))
    # the margin is for rounding; the exact condition comes after the join
    near = dots.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_p") - high) / width - 1e-6), F.floor((F.col("_p") - low) / width + 1e-6))))
    every = own.select(*by, "_b").distinct().join(dots.select(*by, *unit).distinct(), by).withColumn("_p", F.lit(None).cast(points.schema[point].dataType))
    dealt = [df.repartition(parts, *by, "_b") for df in (own, near.unionByName(every))]
    return dealt[0].join(dealt[1], [*by, "_b"]).where(F.col("_p").isNull() | ((F.col("_p") >= F.col("_e") + low) & (F.col("_p") < F.col("_e") + high)))


def count_in_windows(points: DataFrame, events: DataFrame, *, by: list[str], point: str, event: str, windows: dict[str, tuple[float, float]], unit: list[str], event_key: list[str]) -> DataFrame:
    """(by, event_key, unit, one count per window): points within [event + a, event + b) for each event and unit of its key. Counts are summed in one pass, and units without a point count 0."""
    low, high = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    near = _pairs(points, events, by=by, point=point, event=event, low=low, high=high, unit=unit, event_key=event_key)
    counted = near.groupBy(*by, "_b", *event_key, *unit).agg(*[F.count_if((F.col("_p") >= F.col("_e") + a) & (F.col("_p") < F.col("_e") + b)).alias(n) for n, (a, b) in windows.items()])
    return counted.select(*by, *event_key, *unit, *windows)


def histograms_around(points: DataFrame, events: DataFrame, *, by: list[str], point: str, event: str, start: float, width: float, bins: int, unit: list[str], event_key: list[str]) -> DataFrame:
    """(by, event_key, unit, counts): an array of points by bins of equal width from event + start; empty bins are 0. Null events have no rows.

    A bin's edges are computed as event + (start + k * width), so points on an edge fall where the edge says.
    """
    near = _pairs(points, events.where(F.col(event).isNotNull()), by=by, point=point, event=event, low=start, high=start + bins * width, unit=unit, event_key=event_key)
    guess = F.floor((F.col("_p") - F.col("_e") - start) / width).cast("int")
    edge = lambda k: F.col("_e") + (F.lit(start) + k * F.lit(width))
    k = F.when(F.col("_p") < edge(guess), guess - 1).when(F.col("_p") >= edge(guess + 1), guess + 1).otherwise(guess)
    counted = near.withColumn("_k", k).groupBy(*by, "_b", *event_key, *unit).agg(F.array(*[F.count_if(F.col("_k") == i) for i in range(bins)]).alias("counts"))
    return counted.select(*by, *event_key, *unit, "counts")


def histogram_around(points: DataFrame, events: DataFrame, *, by: list[str], point: str, event: str, start: float, width: float, bins: int, unit: list[str], event_key: list[str]) -> DataFrame:
    """(by, event_key, unit, bin, n): histograms_around with a row for each bin."""
    rows = histograms_around(points, events, by=by, point=point, event=event, start=start, width=width, bins=bins, unit=unit, event_key=event_key)
    return rows.select(*by, *event_key, *unit, F.posexplode("counts").alias("bin", "n"))


def region_pairs(units: DataFrame, *, source: str, subject: str, region: str, minimum: int) -> tuple[DataFrame, DataFrame]:
    """(sessions, pairs): ordered pairs of different regions that a source has, and their coverage over subjects.

    sessions: source, subject, source_region, target_region, n_source, n_target, qualifies. pairs: counts and the median over subjects of each subject's mean.
    """
    sizes = units.where(F.col(region).isNotNull()).groupBy(source, subject, region).agg(F.count("*").alias("n"))
    a, b = sizes.select(source, subject, F.col(region).alias("source_region"), F.col("n").alias("n_source")), sizes.select(source, F.col(region).alias("target_region"), F.col("n").alias("n_target"))
    sessions = a.join(b, source).where("source_region <> target_region").withColumn("qualifies", (F.col("n_source") >= minimum) & (F.col("n_target") >= minimum))
    by_subject = sessions.where("qualifies").groupBy(subject, "source_region", "target_region").agg(F.count("*").alias("n"), F.avg("n_source").alias("s"), F.avg("n_target").alias("t"))
    pairs = by_subject.groupBy("source_region", "target_region").agg(F.count("*").alias("n_subjects"), F.sum("n").alias("n_sessions"), F.percentile("s", 0.5).alias("median_source"), F.percentile("t", 0.5).alias("median_target"))
    return sessions, pairs


def frame_offsets(anchors: DataFrame, frames: DataFrame, *, source: str, anchor_id: str, anchor_frame: str, frame: str, label: str, parts: int | None = None) -> DataFrame:
    """(source, offset): the one integer offset that maps every anchor of a source one-to-one to a frame with its label; none if several or no offset does.

    Offsets are proposed by the source's rarest label only, then verified by counting. Frames and anchors are united and dealt by source once; all that
    follows are windows and groupings within it. parts: partitions they are dealt to; by default Spark's own number.
    """
    none = F.lit(None)
    here, there = anchors.schema, frames.schema
    own = anchors.select(source, F.lit(False).alias("_is"), F.col(anchor_id).alias("_id"), F.col(anchor_frame).alias("_a"), F.col(label).alias("_l"), none.cast(there[frame].dataType).alias("_f"))
    other = frames.select(source, F.lit(True).alias("_is"), none.cast(here[anchor_id].dataType).alias("_id"), none.cast(here[anchor_frame].dataType).alias("_a"), F.col(label).alias("_l"), F.col(frame).alias("_f"))
    both = own.unionByName(other).where(F.col(source).isNotNull())
    both = both.repartition(parts, source) if parts else both.repartition(source)
    whole = Window.partitionBy(source)
    both = both.withColumn("_n", F.count_if("_is").over(Window.partitionBy(source, "_l")))
    rarest = F.min(F.when(~F.col("_is") & F.col("_l").isNotNull() & (F.col("_n") > 0), F.struct("_n", "_l", "_a"))).over(whole)
    both = both.withColumns({"_pick": rarest, "_total": F.count_if(~F.col("_is")).over(whole)}).where("_pick is not null")
    proposed = F.collect_set(F.when(F.col("_is") & (F.col("_l") == F.col("_pick._l")), F.col("_f") - F.col("_pick._a"))).over(whole)
    both = both.withColumn("_offsets", proposed).withColumn("offset", F.explode(F.when(F.col("_is"), F.array(none)).otherwise(F.col("_offsets")))).drop("_offsets", "_pick", "_n")
    both = both.withColumn("_f", F.when(F.col("_is"), F.col("_f")).otherwise(F.col("_a") + F.col("offset")))
    met = both.withColumn("_met", F.max("_is").over(Window.partitionBy(source, "_f", "_l"))).where("_met and not _is and _f is not null and _l is not null")
    right = met.groupBy(source, "offset").agg(F.size(F.collect_set("_id")).alias("ids"), F.size(F.collect_set("_f")).alias("fs"), F.min("_total").alias("n")).where("ids = n and fs = n")
    return right.groupBy(source).agg(F.count("*").alias("k"), F.min("offset").alias("offset")).where("k = 1").select(source, "offset")


def align_by_offset(anchors: DataFrame, frames: DataFrame, offsets: DataFrame, *, source: str, anchor_frame: str, frame: str, values: list[str], start: str, stop: str, event: str) -> DataFrame:
    """anchors with the frame row at anchor + offset: match_count, each value as frame_<value>, residual (event less the frame's start) and ordered failure reasons."""
    one = frames.groupBy(source, F.col(frame).alias("_f")).agg(F.count("*").alias("match_count"), *[F.min(c).alias(f"frame_{c}") for c in [*values, start, stop]])
    joined = anchors.join(offsets, source, "left").withColumn("_f", F.col(anchor_frame) + F.col("offset")).join(one, [source, "_f"], "left")
    joined = joined.withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    only = F.col("match_count") == 1
    agree = {f"{c}_agrees": F.when(only, F.col(c).eqNullSafe(F.col(f"frame_{c}"))) for c in values}
    inside = F.when(only, (F.col(event) >= F.col(f"frame_{start}")) & (F.col(event) < F.col(f"frame_{stop}")))
    joined = joined.withColumns({**agree, "residual": F.when(only, F.col(event) - F.col(f"frame_{start}")), "inside": inside})
    named = [F.when(F.col("offset").isNull(), "no_offset"), F.when(F.col("offset").isNotNull() & (F.col("match_count") == 0), "no_match"), F.when(F.col("match_count") > 1, "ambiguous"), *[F.when(~F.col(f"{c}_agrees"), f"{c}_differs") for c in values], F.when(~F.col("inside"), "event_outside")]
    return joined.withColumn("failures", F.concat_ws(";", *named)).drop("_f")


def ancestor_division(nodes: DataFrame, divisions: DataFrame, *, node: str, path: str, division: str) -> DataFrame:
    """(node, division, n_candidates): the one division among a node's ancestors and itself, null if none or several."""
    steps = nodes.select(node, F.explode(path).alias("_step"))
    found = steps.join(F.broadcast(divisions.select(F.col(division).alias("_step"))), "_step").groupBy(node).agg(F.count("*").alias("n_candidates"), F.min("_step").alias("_d"))
    return nodes.select(node).join(found, node, "left").select(node, F.when(F.col("n_candidates") == 1, F.col("_d")).alias(division), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def tree_paths(edges: DataFrame, *, node: str, parent: str, max_depth: int = 64) -> DataFrame:
    """(node, path): ids from the root, whose parent is null, down to each node. A node deeper than max_depth is an error."""
    view = f"edges_{abs(hash((node, parent))) % 10**9}"
    edges.select(F.col(node).alias("node"), F.col(parent).alias("parent")).createOrReplaceTempView(view)
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE tree(node, path, depth) AS (
            SELECT node, array(node), 0 FROM {view} WHERE parent IS NULL
            UNION ALL
            SELECT e.node, concat(t.path, array(e.node)), IF(t.depth >= {max_depth}, raise_error('tree_paths: a node lies deeper than max_depth'), t.depth + 1)
            FROM tree t JOIN {view} e ON e.parent = t.node
        ) SELECT node AS {node}, path FROM tree""")

