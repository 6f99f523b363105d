"""Scans with contracts and provenance, catalogs of tables and assets, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, image_contrast, image_identity, is_finite, session_asset

SOURCE, TABLE, INDEX = "_source", "_table", "_index"


class ContractError(ValueError):
    """A table lacks a required column, or has it under another type."""


def project_contract(df: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """The contract's columns in order, cast to its types; an absent optional one is a typed null, an absent required one an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    both = {**required, **(optional or {})}
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in both.items()])


def scan_table(spark: SparkSession, paths: str | list[str], table: str, columns: list[str] | None = None, *, provenance: bool = True, index: str | None = None) -> DataFrame:
    """Rows of a table that lies under the same name, starting with `/`, in many places: its columns once each in order, and where each row came from.

    The row index must be a column of the data. Column pruning and pushed filters reach the files.
    """
    if not table.startswith("/"):
        raise ContractError("a table's path starts with /")
    places = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*[f"{p}{table}.parquet" for p in places])
    own = list(dict.fromkeys(columns or df.columns))
    extra = [F.col("_metadata.file_path").alias(SOURCE), F.lit(table).alias(TABLE), (F.col(index) if index else F.lit(None)).cast("bigint").alias(INDEX)] if provenance else []
    return df.select(*own, *extra)


def scan_filtered(spark: SparkSession, path: str, condition: Column, columns: list[str]) -> DataFrame:
    """A filter before a projection; large arrays that columns doesn't name are never read."""
    return spark.read.parquet(path).where(condition).select(*columns)


def union_tables(parts: list[DataFrame]) -> DataFrame:
    """The union of tables whose schemas differ by missing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_exact(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """The union of tables of one schema, sorted; a different schema is an error."""
    first = parts[0].schema.simpleString()
    if any(p.schema.simpleString() != first for p in parts):
        raise ContractError("schemas differ")
    return reduce(DataFrame.unionByName, parts).orderBy(*order)


def presentation_tables(catalog: DataFrame, *, source: str, table: str, column: str, required: list[str], name_pattern: str = ".*", not_pattern: str = "flash|gabor|spontaneous") -> DataFrame:
    """(source, n_candidates, table): per source the one table with all required columns and a fitting name; null if none or several."""
    tables = catalog.groupBy(source, table).agg(F.collect_set(column).alias("columns"))
    ok = (F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.col("columns"))) == 0) & F.col(table).rlike(name_pattern) & ~F.col(table).rlike(not_pattern)
    out = tables.groupBy(source).agg(F.count_if(ok).alias("n_candidates"), F.min(F.when(ok, F.col(table))).alias(table))
    return out.select(source, "n_candidates", F.when(F.col("n_candidates") == 1, F.col(table)).alias(table))


def candidate_tables(catalog: DataFrame, *, source: str, table: str, column: str, required: list[str]) -> DataFrame:
    """All tables with the required columns, in order of name."""
    tables = catalog.groupBy(source, table).agg(F.collect_set(column).alias("columns"))
    return tables.where(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.col("columns"))) == 0).select(source, table).orderBy(source, table)


def companion_flags(rows: DataFrame, *, keys: list[str], flag: str, row: str, valid: Column) -> DataFrame:
    """One row per key: the first flag that isn't null by row number, distinct flags, rows, first and last row, conflict."""
    kept = rows.where(valid)
    out = kept.groupBy(*keys).agg(
        F.min_by(flag, F.when(F.col(flag).isNotNull(), F.col(row))).alias(flag), F.countDistinct(flag).alias("n_flags"), F.count("*").alias("n_rows"), F.min(row).alias("first_row"), F.max(row).alias("last_row"),
    )
    return out.withColumn("conflict", F.col("n_flags") > 1)


def session_metadata(df: DataFrame, *, identifier: str, nullable_id: str) -> DataFrame:
    """df with session_id (the identifier as a number, or null), is_valid and conflict with a nullable number."""
    number = F.col(identifier).try_cast("bigint")
    return df.withColumns({"session_id": number, "is_valid": number.isNotNull(), "conflict": F.coalesce(number != F.col(nullable_id), F.lit(False))})


def asset_manifest(records: DataFrame, *, asset_id: str, path: str, size: str, urls: str | None = None, url_like: str = "https") -> DataFrame:
    """(asset_id, path, size, kind, subject, url): assets typed as session, probe or other by path; the first url that fits."""
    p = F.col(path)
    kind = F.when(session_asset(p), "session").when(p.rlike(r"_probe-?\d+"), "probe").otherwise("other")
    url = F.lit(None).cast("string") if urls is None else F.get(F.filter(urls, lambda u: F.startswith(u, F.lit(url_like))), F.lit(0))
    return records.select(F.col(asset_id).alias("asset_id"), p.alias("path"), F.col(size).cast("bigint").alias("size"), kind.alias("kind"), extract(p, r"^sub-([^/]+)/").alias("subject"), url.alias("url"))


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(rule, n_violations): repeated or null ids and paths, negative sizes."""
    from ..operators.expect import all_of, expect_rows, expect_unique

    return all_of(expect_unique(manifest, ["asset_id"], "unique_asset"), expect_unique(manifest, ["path"], "unique_path"), expect_rows(manifest, {"size_not_negative": F.col("size") >= 0}))


def manifest_summary(manifest: DataFrame, media: str = r"(?i)\.(mp4|avi|mov)$") -> DataFrame:
    """Assets, bytes, subjects and media files by kind."""
    return manifest.groupBy("kind").agg(F.count("*").alias("n_assets"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.countDistinct("subject").alias("n_subjects"), F.count_if(F.col("path").rlike(media)).alias("n_media"))


def select_sessions(manifest: DataFrame, *, subjects: list[str] | None = None, order: str = "path", limit: int | None = None) -> DataFrame:
    """Session assets of some subjects (`sub-` is left out), in order, at most limit."""
    out = manifest.where("kind = 'session'")
    if subjects is not None:
        out = out.where(F.col("subject").isin([s.removeprefix("sub-") for s in subjects]))
    out = out.orderBy(order)
    return out if limit is None else out.limit(limit)


def signal(series: DataFrame, name: str, *, signal_column: str = "signal") -> DataFrame:
    """One named signal of a long table of (source, signal, ts, value), finite times only."""
    return series.where((F.col(signal_column) == name) & is_finite("ts")).select("source", F.col("ts").cast("double").alias("ts"), F.col("value").cast("double").alias("value"))


def attributes(pairs: DataFrame, *, source: str, key: str, value: str) -> DataFrame:
    """Key-value rows as one map per source; of a repeated key the greatest value."""
    one = pairs.groupBy(source, key).agg(F.max(value).alias("v"))
    return one.groupBy(source).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "v")))).alias("attributes"))


def rows_at(df: DataFrame, indices: DataFrame, *, index: str, position: str) -> DataFrame:
    """Rows at given indices, with their position in the request."""
    return indices.select(index, position).join(df, index)


def unit_inventory(units: DataFrame, electrodes: DataFrame, sessions: DataFrame, *, source: str = "source") -> DataFrame:
    """Units with their electrode (m:1), session (m:1), quality flag and reasons, and key; no array columns."""
    from ..functions import unit_reasons, well_isolated
    from ..operators.joins import join_checked

    flat = units.select(*[f.name for f in units.schema.fields if f.dataType.typeName() != "array"])
    out = join_checked(flat, electrodes, [source, "peak_channel"], "left", "m:1")
    out = join_checked(out, sessions, [source], "left", "m:1")
    return out.withColumns({"is_well_isolated": well_isolated(), "exclusion_reasons": unit_reasons(), "unit_key": F.concat_ws(":", source, "unit")})


def task_presentations(rows: DataFrame, sessions: DataFrame, *, source: str = "source", image: str = "image_name", frame: str = "start_frame", index: str = "idx", novel: str = "novel_image", parts: int | None = None) -> DataFrame:
    """Presentations with image identity and contrast, session columns, exposure and whether the image is the session's designated novel one."""
    from ..operators.blocks import exposure_index

    # what follows from a row alone is added after the sort, which then holds less
    out = exposure_index(rows, image, by=[source], order=[frame, index], parts=parts)
    out = out.withColumns({"image_id": image_identity(image), "contrast": image_contrast(image)}).join(sessions, source, "left")
    return out.withColumn("is_designated_novel", F.coalesce(F.col("image_id") == F.col(novel), F.lit(False)))


def write_table(df: DataFrame, path: str) -> None:
    """Write by the path's ending: .parquet (zstd), .csv or .json (lines); what was there is replaced."""
    kind = path.rsplit(".", 1)[-1]
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "ndjson"):
        writer.json(path)
    else:
        raise ValueError(f"no writer for .{kind}")
