"""Views that read the TPC-H-like test tables as manifests, signals, bags, sequences and predictions.

Every view exists twice, once for Spark and once as SQL text for the check, with the same integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
MANIFEST_CLASSES = ("A", "N", "R")
CLASSES = tuple(f"c{i}" for i in range(9))
RUNS = 4

# A read holds the samples of one user within one span of event ids, so no read is longer than the span.
READ_SPAN = 100_000

SQL_VIEWS = {
    "manifest": """
      SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS read_id,
             l_returnflag AS barcode,
             CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
             'raw/' || l_returnflag || '/r' || CAST(l_suppkey % 7 AS VARCHAR) || '_s' || CAST(l_suppkey AS VARCHAR)
               || '.ccf5' AS ccf_file,
             CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'val' ELSE 'test' END AS split,
             CASE WHEN l_partkey % 10 < 5 THEN 'train' WHEN l_partkey % 10 = 5 THEN 'atlas'
                  WHEN l_partkey % 10 < 8 THEN 'val' ELSE 'test' END AS legacy_split,
             l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
      FROM lineitem""",
    "reads": """
      SELECT * EXCLUDE (occurrence) FROM (
        SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                     l_quantity, l_extendedprice) AS occurrence FROM manifest)
      WHERE occurrence = 1""",
    "predictions": """
      SELECT 'e' || CAST(event_id AS VARCHAR) AS read_id, event_id,
             CAST(event_id % 9 AS INTEGER) AS true_label,
             CAST(CASE WHEN event_id % 5 <> 0 THEN event_id % 9 ELSE (event_id % 9 + 1) % 9 END AS INTEGER)
               AS predicted_label,
             CAST(CASE WHEN event_id % 5 <> 0 THEN 300 + 7 * (((event_id * 7919) % 1000) // 10)
                       ELSE 6 * (((event_id * 7919) % 1000) // 10) END AS DOUBLE) / 1000 AS confidence,
             'g' || CAST(event_id % 9 AS VARCHAR) || '_' || CAST(user_id % 7 AS VARCHAR) AS ccf_file,
             CASE WHEN (event_id // 9) % 2 = 0 THEN 'val' ELSE 'test' END AS split
      FROM events""",
    "run_predictions": """
      SELECT r AS run_id, 'e' || CAST(event_id AS VARCHAR) AS read_id, event_id,
             CAST(event_id % 9 AS INTEGER) AS true_label,
             CAST(CASE WHEN (event_id * (2 * r + 7) + r) % (5 + r) <> 0 THEN event_id % 9
                       ELSE (event_id % 9 + 1) % 9 END AS INTEGER) AS predicted_label,
             CAST(CASE WHEN (event_id * (2 * r + 7) + r) % (5 + r) <> 0
                       THEN 300 + 7 * (((event_id * 7919) % 1000) // 10)
                       ELSE 6 * (((event_id * 7919) % 1000) // 10) END AS DOUBLE) / 1000 AS confidence,
             'g' || CAST(event_id % 9 AS VARCHAR) || '_' || CAST(user_id % 7 AS VARCHAR) AS ccf_file,
             CASE WHEN (event_id // 9) % 2 = 0 THEN 'val' ELSE 'test' END AS split
      FROM events, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS r)""",
    "samples": """
      SELECT 'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id // 100000 AS VARCHAR) AS read_id,
             'f' || CAST(user_id % 10 AS VARCHAR) AS source_file, user_id AS source_read_index,
             CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(user_id % 5 AS DOUBLE) END AS lvdsmid,
             CAST(0.5 AS DOUBLE) AS unit,
             CAST(row_number() OVER (PARTITION BY user_id, event_id // 100000 ORDER BY ts, event_id) - 1 AS BIGINT)
               AS pos, CAST(floor(value) AS INTEGER) AS raw
      FROM events""",
    "physical": """
      SELECT read_id, source_file, pos,
             CASE WHEN lvdsmid IS NOT NULL THEN (raw - lvdsmid) * unit
                  ELSE 0.25 * 2.0 * (((raw % 65536) + 65536) % 65536 + 3.0) + 1.5 END AS x
      FROM samples""",
    "bags": """
      SELECT 'b' || CAST(vec_id // 5 AS VARCHAR) AS read_id, CAST(vec_id % 5 AS INTEGER) AS chunk_index, vec_id,
             embedding, label,
             CASE WHEN (vec_id // 5) % 10 < 6 THEN 'train' WHEN (vec_id // 5) % 10 < 8 THEN 'val' ELSE 'test' END
               AS split
      FROM embeddings""",
    "sequences": """
      SELECT 'd' || CAST(doc_id AS VARCHAR) AS read_id, lang AS barcode, source AS ccf_file,
             regexp_replace(lower(text), '[^acgt]', '', 'g') AS seq
      FROM documents""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber) AS read_id",
        "l_returnflag AS barcode",
        "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label",
        "concat('raw/', l_returnflag, '/r', l_suppkey % 7, '_s', l_suppkey, '.ccf5') AS ccf_file",
        "CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'val' ELSE 'test' END AS split",
        """CASE WHEN l_partkey % 10 < 5 THEN 'train' WHEN l_partkey % 10 = 5 THEN 'atlas'
                WHEN l_partkey % 10 < 8 THEN 'val' ELSE 'test' END AS legacy_split""",
        *ROW_ORDER,
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with only the first row of every read id."""
    from sigspark.operators.prefix import first_k

    return first_k(manifest(spark, sf_dir), ["read_id"], ROW_ORDER, 1, "occurrence").drop("occurrence")


_RANK = "((event_id * 7919) % 1000) div 10"


def _predicted(correct: str) -> list[str]:
    return [
        "concat('e', event_id) AS read_id",
        "event_id",
        "CAST(event_id % 9 AS INT) AS true_label",
        f"CAST(CASE WHEN {correct} THEN event_id % 9 ELSE (event_id % 9 + 1) % 9 END AS INT) AS predicted_label",
        f"CAST(CASE WHEN {correct} THEN 300 + 7 * ({_RANK}) ELSE 6 * ({_RANK}) END AS DOUBLE) / 1000D AS confidence",
        "concat('g', event_id % 9, '_', user_id % 7) AS ccf_file",
        "CASE WHEN (event_id div 9) % 2 = 0 THEN 'val' ELSE 'test' END AS split",
    ]


def predictions_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_predicted("event_id % 5 <> 0"))


def predictions(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    rows = predictions_of(table(spark, sf_dir, "events"))
    return rows if split is None else rows.where(F.col("split") == split)


def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.explode(F.array(*[F.lit(r) for r in range(RUNS)])).alias("run_id")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", runs)
        .selectExpr("run_id", *_predicted("(event_id * (2 * run_id + 7) + run_id) % (5 + run_id) <> 0"))
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per read; every eleventh user carries the second calibration variant."""
    samples = table(spark, sf_dir, "events").groupBy(
        "user_id", F.expr(f"event_id div {READ_SPAN}").alias("span")
    ).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", F.floor("value").cast("int").alias("raw")))).alias("s")
    )
    plain = F.col("user_id") % 11 != 0
    return samples.select(
        F.concat(F.lit("u"), "user_id", F.lit("-"), "span").alias("read_id"),
        F.concat(F.lit("f"), F.col("user_id") % 10).alias("source_file"),
        F.col("user_id").alias("source_read_index"),
        F.col("s.raw").alias("signal"),
        F.when(plain, (F.col("user_id") % 5).cast("double")).alias("lvdsmid"),
        F.lit(0.5).alias("unit"),
        F.lit(0.25).alias("k"),
        F.lit(2.0).alias("scale"),
        F.lit(3.0).alias("offset"),
        F.lit(1.5).alias("b"),
    )


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('b', vec_id div 5) AS read_id",
        "CAST(vec_id % 5 AS INT) AS chunk_index",
        "vec_id",
        "embedding",
        "label",
        """CASE WHEN (vec_id div 5) % 10 < 6 THEN 'train' WHEN (vec_id div 5) % 10 < 8 THEN 'val' ELSE 'test' END
           AS split""",
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('d', doc_id) AS read_id",
        "lang AS barcode",
        "source AS ccf_file",
        "regexp_replace(lower(text), '[^acgt]+', '') AS seq",
    )
