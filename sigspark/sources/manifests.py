"""Manifest tables: one row per read with its class, split and source file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "val", "test")

# fixed values: column sets of the manifest files that users already have
AUDIT_COLUMNS = ("read_id", "split", "barcode", "label")
BAG_COLUMNS = (
    "split", "split_order", "barcode", "label", "read_id", "part_id", "part_base", "part_read_index", "chunk_start",
    "n_chunks", "chunk_path", "ccf_file", "ccf_read_index",
)
RAW_COLUMNS = ("split", "split_order", "barcode", "label", "read_id", "raw_chunk_path", "raw_chunk_start", "raw_n_chunks")
RAW_OPTIONAL = ("chunk_path", "chunk_start", "ccf_file", "preprocessing_profile_id")

_INTEGERS = {"label": "int", "split_order": "long", "part_read_index": "long", "chunk_start": "long", "n_chunks": "int",
             "ccf_read_index": "long", "raw_chunk_start": "long", "raw_n_chunks": "int"}


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def read_manifest(spark: SparkSession, path: str, *, kind: str = "audit") -> DataFrame:
    """Manifest from CSV (header) or Parquet, typed; ``kind`` is audit, bag or raw."""
    if path.rstrip("/").endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
    else:
        rows = spark.read.parquet(path)
    base = path.rstrip("/").rsplit("/", 1)[0] if "/" in path else "."
    return normalize_manifest(rows, kind=kind, base=base)


def normalize_manifest(rows: DataFrame, *, kind: str = "audit", base: str = ".") -> DataFrame:
    """Check columns, cast integers, and for bag and raw manifests keep known splits and resolve chunk paths."""
    required = {"audit": AUDIT_COLUMNS, "bag": BAG_COLUMNS, "raw": RAW_COLUMNS}[kind]
    require_columns(rows, required, f"{kind} manifest")
    rows = rows.withColumns({c: F.col(c).cast(t) for c, t in _INTEGERS.items() if c in rows.columns})
    if kind == "audit":
        return rows
    rows = rows.where(F.col("split").isin(*SPLITS))
    if kind == "raw":
        absent = [c for c in RAW_OPTIONAL if c not in rows.columns]
        kinds = {"chunk_start": T.LongType()}
        rows = rows.withColumns({c: F.lit(None).cast(kinds.get(c, T.StringType())) for c in absent})
        rows = rows.withColumns({c: resolve_path(F.col(c), base) for c in ("raw_chunk_path", "chunk_path")})
    return rows


def resolve_path(path: Column, base: str) -> Column:
    """Relative paths count from the folder of the manifest."""
    absolute = path.startswith("/") | path.contains("://")
    return F.when(absolute | (path == ""), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def run_prefix(path: Column) -> Column:
    """The part of a file name before its first underscore."""
    return F.split_part(basename(path), F.lit("_"), F.lit(1))


def group_file(rows: DataFrame) -> Column:
    """Base name of the source file, from either of its two column names; NULL when both are empty."""
    candidates = [F.nullif(F.col(c), F.lit("")) for c in ("ccf_file", "source_ccf_file") if c in rows.columns]
    return basename(F.coalesce(*candidates)) if candidates else F.lit(None).cast("string")


def assert_manifest(rows: DataFrame, n_classes: int, profile_id: str | None = None) -> DataFrame:
    """One row of facts, in one pass, that raises at run time unless the manifest is usable.

    Not empty, labels inside the declared classes, and a single preprocessing profile equal to the expected one.
    """
    has_profile = "preprocessing_profile_id" in rows.columns
    profile = F.col("preprocessing_profile_id") if has_profile else F.lit(None).cast("string")
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("label").alias("min_label"),
        F.max("label").alias("max_label"),
        F.min(profile).alias("first_profile"),
        F.max(profile).alias("last_profile"),
    )
    wrong = (F.col("min_label") < 0) | (F.col("max_label") >= n_classes)
    mixed = F.col("first_profile") != F.col("last_profile")
    other = F.lit(False) if profile_id is None else ~F.col("first_profile").eqNullSafe(F.lit(profile_id))
    raise_ = lambda text: F.raise_error(F.lit(text)).cast("long")
    checked = (
        F.when(F.col("rows") == 0, raise_("manifest is empty"))
        .when(wrong, raise_("label outside the declared classes"))
        .when(mixed, raise_("manifest mixes preprocessing profiles"))
        .when(other, raise_("manifest was built with another preprocessing profile"))
        .otherwise(F.col("rows"))
    )
    return facts.withColumn("rows", checked)
