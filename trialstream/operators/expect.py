"""Expectations of tables: each returns rows (rule, n_violations); enforce raises where any is above 0.

All conditions on one table are one aggregate; keys and coverage take one grouping or anti-join each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dtype_compatible, is_finite


class ExpectationError(ValueError):
    """A table doesn't meet its expectations."""


def expect_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule; a null condition breaks it."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_violations")) for i, n in enumerate(rules)])).alias("r")).select("r.*")


def expect_unique(df: DataFrame, keys: list[str], rule: str = "unique_key") -> DataFrame:
    """Null keys, and rows beyond the first of each key."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n")).select(F.when(any_null, F.col("n")).otherwise(F.col("n") - 1).alias("bad"))
    return by_key.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def expect_coverage(df: DataFrame, expected: DataFrame, keys: list[str], rule: str = "coverage") -> DataFrame:
    """Keys that only one of the two tables has."""
    a, b = df.select(*keys).distinct(), expected.select(*keys).distinct()
    both = a.join(b, keys, "left_anti").unionByName(b.join(a, keys, "left_anti"))
    return both.agg(F.count("*").alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def expect_equal(df: DataFrame, expected: DataFrame, rule: str = "equal") -> DataFrame:
    """Rows, with repeats, that only one of the two tables has."""
    cols = expected.columns
    both = df.select(*cols).exceptAll(expected).unionByName(expected.exceptAll(df.select(*cols)))
    return both.agg(F.count("*").alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def expect_contiguous(df: DataFrame, source: str, index: str, rule: str = "contiguous_index") -> DataFrame:
    """Sources whose index isn't exactly 0 to n - 1."""
    by = df.groupBy(source).agg(F.min(index).alias("a"), F.max(index).alias("b"), F.countDistinct(index).alias("d"), F.count("*").alias("n"))
    bad = ~F.coalesce((F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("d") == F.col("n")), F.lit(False))
    return by.agg(F.count_if(bad).alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def expect_constant(df: DataFrame, by: list[str], columns: list[str], rule: str = "constant_within_group") -> DataFrame:
    """Groups in which one of the columns has several values; null counts as a value."""
    several = reduce(lambda a, b: a | b, [F.countDistinct(c) + F.max(F.col(c).isNull().cast("int")) > 1 for c in columns])
    return df.groupBy(*by).agg(several.alias("bad")).agg(F.count_if("bad").alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def expect_minimum(df: DataFrame, by: list[str], condition: Column, minimum: int, rule: str = "minimum_support", grid: DataFrame | None = None) -> DataFrame:
    """Groups, of the grid if one is given, with fewer rows than minimum that meet the condition."""
    found = df.groupBy(*by).agg(F.count_if(condition).alias("n"))
    if grid is not None:
        found = grid.select(*by).distinct().join(found, by, "left").fillna(0, ["n"])
    return found.agg(F.count_if(F.col("n") < minimum).alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("rule", F.col("n_violations").cast("bigint").alias("n_violations")) for p in parts])


def enforce(violations: DataFrame) -> None:
    """Raises ExpectationError that names the broken rules. The rules are few, so they come to the driver."""
    bad = violations.where("n_violations > 0").collect()
    if bad:
        raise ExpectationError(", ".join(f"{r['rule']}: {r['n_violations']}" for r in sorted(bad, key=lambda r: r["rule"])))


#: Columns of the statistics table and their types.
STATISTICS_COLUMNS = {
    "result_id": "string", "contrast_id": "string", "hypothesis": "string", "tier": "string", "status": "string", "status_reason": "string", "metric": "string", "scale": "string", "estimate": "double", "ci_low": "double", "ci_high": "double",
    "confidence_level": "double", "ci_method": "string", "null_value": "double", "p_value": "double", "adjusted_p_value": "double", "sidedness": "string", "test_method": "string", "multiplicity_family": "string", "multiplicity_method": "string",
    "n_mice": "bigint", "n_sessions": "bigint", "n_units": "bigint", "n_trials": "bigint", "n_bootstrap": "bigint", "n_resamples": "bigint", "seed": "bigint", "inclusion_definition": "string", "model_formula": "string", "source_table": "string",
    "data_version": "string", "code_version": "string", "config_hash": "string", "notes": "string",
}
TIERS, STATUSES, SIDES = ("primary", "secondary", "exploratory"), ("estimated", "point_only", "not_estimable", "pending"), ("two_sided", "greater", "less")


def statistics_table(df: DataFrame) -> DataFrame:
    """df with the statistics table's columns in order: absent ones null, text trimmed and null if empty. An unknown column raises."""
    unknown = sorted(set(df.columns) - set(STATISTICS_COLUMNS))
    if unknown:
        raise ExpectationError(f"unknown columns: {', '.join(unknown)}")

    def one(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name).cast(kind)
        return (F.nullif(F.trim(c), F.lit("")) if kind == "string" else c).alias(name)

    return df.select(*[one(n, k) for n, k in STATISTICS_COLUMNS.items()])


def statistics_rules() -> dict[str, Column]:
    """Rules of each row of a statistics table."""
    ok_or_null = lambda c, cond: F.col(c).isNull() | cond
    p = lambda c: ok_or_null(c, is_finite(c) & F.col(c).between(0, 1))
    both = F.col("ci_low").isNotNull() == F.col("ci_high").isNotNull()
    return {
        "result_id": F.col("result_id").isNotNull(), "tier": F.col("tier").isin(*TIERS), "status": F.col("status").isin(*STATUSES), "sidedness": ok_or_null("sidedness", F.col("sidedness").isin(*SIDES)),
        "estimate_finite": ok_or_null("estimate", is_finite("estimate")), "p_value": p("p_value"), "adjusted_p_value": p("adjusted_p_value"), "interval_complete": both, "interval_order": F.col("ci_low").isNull() | F.col("ci_high").isNull() | (F.col("ci_low") <= F.col("ci_high")),
        "interval_companions": F.col("ci_low").isNull() | (F.col("confidence_level").isNotNull() & F.col("ci_method").isNotNull()), "family_for_adjusted": F.col("adjusted_p_value").isNull() | F.col("multiplicity_family").isNotNull(),
        "estimated_has_estimate": (F.col("status") != "estimated") | F.col("estimate").isNotNull(), "reason_given": (F.col("status") == "estimated") | F.col("status_reason").isNotNull(),
    }


def broken_rules(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) of each row and rule that it breaks."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(key, F.explode(names).alias("rule"))


def schema_audit(catalog: DataFrame, required: DataFrame, *, source: str = "source", table: str = "table_id", column: str = "column", dtype: str = "dtype") -> DataFrame:
    """For every source and required column: present, its type and whether the type is compatible.

    required: (table_id, column, expected, is_required).
    """
    grid = catalog.select(source).distinct().join(F.broadcast(required))
    found = catalog.groupBy(source, table, column).agg(F.min(dtype).alias(dtype))
    out = grid.join(found, [source, table, column], "left")
    return out.withColumns({"is_present": F.col(dtype).isNotNull(), "is_compatible": F.coalesce(dtype_compatible(dtype, "expected"), ~F.col("is_required")) | (F.col(dtype).isNull() & ~F.col("is_required"))})


def schema_variants(catalog: DataFrame, *, source: str = "source", table: str = "table_id", column: str = "column", dtype: str = "dtype") -> DataFrame:
    """(source, table, digest): SHA-256 of the JSON of a table's sorted columns and types."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(column).alias("column"), F.col(dtype).alias("dtype"))))
    return catalog.groupBy(source, table).agg(F.sha2(F.to_json(pairs), 256).alias("digest"))


def schema_summary(audit: DataFrame, variants: DataFrame, *, table: str = "table_id", column: str = "column", dtype: str = "dtype") -> DataFrame:
    """Per table and column: presence, compatibility, observed types; with the number of variants of the table."""
    kinds = F.array_join(F.sort_array(F.collect_set(dtype)), ";")
    out = audit.groupBy(table, column).agg(F.count("*").alias("n_sources"), F.count_if("is_present").alias("n_present"), F.count_if("is_compatible").alias("n_compatible"), kinds.alias("dtypes"), F.bool_or("is_required").alias("is_required"))
    counts = variants.groupBy(table).agg(F.countDistinct("digest").alias("n_variants"))
    missing = F.col("is_required") & (F.col("n_present") < F.col("n_sources"))
    return out.join(counts, table, "left").withColumn("status", F.when(missing, "missing").when(F.col("n_compatible") < F.col("n_sources"), "incompatible").otherwise("pass"))
