"""Audits of nested attributes: JSON documents as VARIANT, a typed row for each source and path, compared with a contract.

A document is parsed once; a contract's paths are read from it in one projection. Failures are rows, never exceptions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import expect as X

#: Kinds of VARIANT values that a type accepts.
ACCEPTED = {"string": ("STRING",), "boolean": ("BOOLEAN",), "bigint": ("BIGINT",), "double": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "array<double>": ("ARRAY",), "object": ("OBJECT",)}


#: Sources whose audit one partition holds, about.
SOURCES_IN_PART = 50_000


@dataclass(frozen=True)
class Attribute:
    """A path of a document, its type, and the value it must have: a constant, or that of a column of the source's row."""

    name: str
    path: str
    type: str = "string"
    expected: object = None
    expected_column: str | None = None
    required: bool = True


def with_document(df: DataFrame, json: str, name: str = "_v") -> DataFrame:
    """df with its JSON text parsed as VARIANT; null where it can't be."""
    return df.withColumn(name, F.try_parse_json(json))


def kind_of(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, ARRAY, OBJECT, ... of a VARIANT."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def attribute_rows(df: DataFrame, *, source: str, json: str, depth: int = 8) -> DataFrame:
    """(source, path, kind, value) of every key of the documents: objects have a row and so have their keys, down to depth; arrays are values. value is JSON text.

    A document that can't be read has one row of kind UNREADABLE and path $; a null one has none.
    """
    spark = df.sparkSession
    documents = with_document(df.where(F.col(json).isNotNull()).select(F.col(source).alias("_s"), json), json)
    level = documents.where("_v is not null").select("_s", F.lit("$").alias("_p"), "_v")
    out = documents.where("_v is null").select(F.col("_s").alias(source), F.lit("$").alias("path"), F.lit("UNREADABLE").alias("kind"), F.col(json).alias("value"))
    for _ in range(depth):
        level = spark.sql("SELECT _s, concat(_p, '.', e.key) AS _p, e.value AS _v FROM {level}, LATERAL variant_explode(_v) AS e", level=level.where(kind_of(F.col("_v")) == "OBJECT"))
        out = out.unionByName(level.select(F.col("_s").alias(source), F.col("_p").alias("path"), kind_of(F.col("_v")).alias("kind"), F.to_json("_v").alias("value")))
    return out


def attribute_audit(df: DataFrame, contract: list[Attribute], *, source: str, json: str) -> DataFrame:
    """A row for each source and attribute: observed (JSON text), expected (JSON text or null) and status.

    status: pass; unreadable, if there is no document or it can't be parsed; missing, or absent where it isn't required, for no value or a JSON null; wrong_type; differs.
    """
    rows = []
    for a in contract:
        value = F.try_variant_get("_v", a.path, "variant")
        there = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))
        typed = F.try_variant_get("_v", a.path, "variant" if a.type == "object" else a.type)
        right = kind_of(value).isin(*ACCEPTED[a.type]) & typed.isNotNull()
        if a.type.startswith("array"):  # elements of another type come as nulls
            right = right & F.forall(typed, lambda x: x.isNotNull())
        wanted = F.col(a.expected_column) if a.expected_column else F.array(*map(F.lit, a.expected)) if isinstance(a.expected, (list, tuple)) else F.lit(a.expected)
        same = F.lit(True) if a.expected is None and a.expected_column is None else F.coalesce(typed == wanted.cast(a.type), F.lit(False))
        text = F.lit(None).cast("string") if a.expected is None and a.expected_column is None else F.to_json(F.struct(wanted.cast(a.type).alias("v")))
        status = F.when(F.col("_v").isNull(), "unreadable").when(~there, "missing" if a.required else "absent").when(~F.coalesce(right, F.lit(False)), "wrong_type").when(~same, "differs").otherwise("pass")
        rows.append(F.struct(F.lit(a.name).alias("attribute"), F.lit(a.path).alias("path"), F.when(there, F.to_json(value)).alias("observed"), F.regexp_extract(text, r'^\{"v":(.*)\}$', 1).alias("expected"), status.alias("status")))
    return with_document(df, json).select(source, F.explode(F.array(*rows)).alias("r")).select(source, "r.*")


def audit_violations(audit: DataFrame, sources: DataFrame, *, source: str, by: str, known_absent: DataFrame | None = None) -> DataFrame:
    """(rule, n_violations) of an audit: one row for each source and key, all sources covered, and for each key its failures.

    known_absent: (source, key) of optional values that are known to be absent; if it is given, absences have to be exactly those.
    """
    # by source once, in partitions that grow in number with the sources: keys aren't gathered in the few tasks that read the documents
    audit = audit.repartition(-(-sources.count() // SOURCES_IN_PART) or 1, source)
    failed = audit.groupBy(by).agg(F.count_if(~F.col("status").isin("pass", "absent")).alias("n_violations")).select(F.concat(F.lit("passes:"), F.col(by)).alias("rule"), "n_violations")
    rules = [X.expect_unique(audit, [source, by], "one_row"), X.expect_coverage(audit, sources, [source], "all_sources"), failed]
    if known_absent is not None:
        rules.append(X.expect_coverage(audit.where("status = 'absent'").select(source, by), known_absent, [source, by], "known_absences"))
    return X.all_of(*rules)


@dataclass(frozen=True)
class Signal:
    """A series of a document: an object with components that hold their lengths, or a rate and a starting time in place of time stamps."""

    name: str
    path: str
    components: tuple[str, ...] = ("data",)
    required: bool = True


def signal_audit(df: DataFrame, signals: list[Signal], *, source: str, json: str) -> DataFrame:
    """A row for each source and signal: is_present, timing (timestamps, rate or none), n_missing components, lengths_match and status.

    status: pass, unreadable, missing (absent where it isn't required), no_clock, missing_component or length_mismatch: every component's length is that of the
    time stamps, if there are any. Only metadata is looked at: time stamps themselves are interval_clock's.
    """
    rows = []
    for s in signals:
        at = lambda part, kind, s=s: F.try_variant_get("_v", f"{s.path}.{part}", kind)
        there = kind_of(F.try_variant_get("_v", s.path, "variant")) == "OBJECT"
        stamps = at("timestamps", "bigint")
        timing = F.when(stamps.isNotNull(), "timestamps").when(at("rate", "double").isNotNull(), "rate").otherwise("none")
        lengths = [at(c, "bigint") for c in s.components]
        absent = sum((x.isNull().cast("int") for x in lengths), F.lit(0))
        match = F.forall(F.array(*lengths), lambda x: x.isNull() | stamps.isNull() | (x == stamps))  # noqa: B023
        present = F.coalesce(there, F.lit(False))
        status = (
            F.when(F.col("_v").isNull(), "unreadable").when(~present, "missing" if s.required else "absent").when(timing == "none", "no_clock").when(absent > 0, "missing_component").when(~match, "length_mismatch").otherwise("pass")
        )
        rows.append(F.struct(F.lit(s.name).alias("signal"), present.alias("is_present"), F.when(present, timing).alias("timing"), F.when(present, absent).alias("n_missing"), F.when(present, match).alias("lengths_match"), status.alias("status")))
    return with_document(df, json).select(source, F.explode(F.array(*rows)).alias("r")).select(source, "r.*")


def signal_summary(audit: DataFrame, *, source: str) -> DataFrame:
    """Per signal: sources audited, present, passing, failing and unreadable, and how many keep time by stamps."""
    return audit.groupBy("signal").agg(
        F.countDistinct(source).alias("n_sources"), F.count_if("is_present").alias("n_present"), F.count_if(F.col("status") == "pass").alias("n_passing"), F.count_if(~F.col("status").isin("pass", "absent")).alias("n_failing"),
        F.count_if(F.col("status") == "unreadable").alias("n_unreadable"), F.count_if(F.col("timing") == "timestamps").alias("n_with_timestamps"),
    )


def combined_clocks(first: DataFrame, second: DataFrame, sessions: DataFrame, *, source: str, names: tuple[str, str]) -> DataFrame:
    """sessions with two audits of interval_clock beside each other, by name: whether their ranges overlap, how far their ends lie apart, and whether both pass and overlap.

    A session that an audit lacks doesn't pass; a source that an audit has twice is an error.
    """
    out = sessions
    for audit, name in zip((first, second), names, strict=True):
        counted = audit.groupBy(source).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"{name}_{c}") for c in audit.columns if c != source])
        once = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"a source with several rows in the {name} audit"))).otherwise(F.col(f"{name}_passes"))
        out = out.join(counted.withColumn(f"{name}_passes", once).drop("_n"), source, "left")
    a, b = names
    c = lambda n, x: F.col(f"{n}_{x}")
    out = out.withColumns({"ranges_overlap": (c(a, "first_start") <= c(b, "last_stop")) & (c(b, "first_start") <= c(a, "last_stop")), "start_offset": c(b, "first_start") - c(a, "first_start"), "stop_offset": c(b, "last_stop") - c(a, "last_stop")})
    no = F.lit(False)
    return out.withColumn("passes", F.coalesce(c(a, "passes"), no) & F.coalesce(c(b, "passes"), no) & F.coalesce("ranges_overlap", no))


def event_dictionary(events: DataFrame, clocks: DataFrame, alignment: DataFrame | None = None, *, source: str, scope: str = "scope", aligned: str = "passes") -> DataFrame:
    """events (one row for each kind of event, with whatever describes it) with what audits say of it: n_sessions, n_passing and status.

    scope names the audit an event rests on: intervals for clocks (combined_clocks), frames for alignment (source and whether it passes). Status is pass if
    every session of the clocks passes, fail if not, not_audited without an alignment or for another scope; no sessions at all fail.
    """
    n = clocks.agg(F.count("*").alias("n_sessions"), F.count_if("passes").alias("n_intervals"))
    if alignment is None:
        n = n.withColumn("n_frames", F.lit(None).cast("bigint"))
    else:
        good = alignment.where(F.col(aligned)).select(source).distinct().join(clocks.select(source), source, "left_semi").agg(F.count("*").alias("n_frames"))
        n = n.join(good)
    passing = F.when(F.col(scope) == "intervals", F.col("n_intervals")).when(F.col(scope) == "frames", F.col("n_frames"))
    status = F.when(passing.isNull(), "not_audited").when((passing == F.col("n_sessions")) & (passing > 0), "pass").otherwise("fail")
    return events.join(n).withColumns({"n_passing": passing, "status": status}).drop("n_intervals", "n_frames")
