"""Signal and chunk tables: schemas and scans."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators.chunks import SignalProfile, read_status
from sigspark.operators.prefix import first_k
from sigspark.sources.files import list_files, plain_path

_D = T.DoubleType()
SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("read_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_read_index", T.LongType()),
        T.StructField("signal", T.ArrayType(T.IntegerType())),
        T.StructField("lvdsmid", _D),
        T.StructField("unit", _D),
        T.StructField("k", _D),
        T.StructField("scale", _D),
        T.StructField("offset", _D),
        T.StructField("b", _D),
    ]
)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Decoded reads from Parquet; a binary read id is decoded as UTF-8."""
    rows = spark.read.parquet(path)
    if dict(rows.dtypes)["read_id"] == "binary":
        rows = rows.withColumn("read_id", F.decode("read_id", "UTF-8"))
    return rows


READ_KEY = ("source_file", "read_id")


def select_reads(rows: DataFrame, wanted: DataFrame, keys: Sequence[str] = READ_KEY) -> DataFrame:
    """Rows of the reads that ``wanted`` names."""
    return rows.join(wanted.select(*keys), list(keys), "left_semi")


def missing_reads(wanted: DataFrame, rows: DataFrame, keys: Sequence[str] = READ_KEY) -> DataFrame:
    """The reads that ``wanted`` names and ``rows`` lacks, each once."""
    return wanted.select(*keys).join(rows.select(*keys), list(keys), "left_anti").distinct()


def first_eligible(spark: SparkSession, path: str, profile: SignalProfile, max_reads: int) -> DataFrame:
    """The first ``max_reads`` eligible reads below a folder, files by path and reads by position; ineligible reads do not count.

    Files are counted in groups of 1, 2, 4 ... until the limit is met; what is counted is one number per file. Files behind the
    limit are listed but never opened, and signals are read from the files taken only.
    """
    order = ["source_read_index", "read_id"]

    def eligible(paths: Sequence[str]) -> DataFrame:
        rows = spark.read.schema(SIGNAL_SCHEMA).parquet(*paths)
        return read_status(rows, profile).where("status = 'eligible'").drop("status")

    listed = (r.path for r in list_files(spark, path, (".parquet",)).select("path").orderBy("path").toLocalIterator())
    whole, taken, size = [], 0, 1
    while taken < max_reads and (group := list(islice(listed, size))):
        size *= 2
        counted = eligible(group).groupBy(F.col("_metadata.file_path").alias("uri")).count().collect()
        found = {plain_path(r.uri): r["count"] for r in counted}
        for file in group:
            n = found.get(plain_path(file), 0)
            if taken + n > max_reads:
                part = first_k(eligible([file]), [], order, max_reads - taken, "nth").drop("nth")
                return eligible(whole).unionByName(part) if whole else part
            if n:
                whole.append(file)
            taken += n
            if taken == max_reads:
                break
    return eligible(whole) if whole else spark.createDataFrame([], SIGNAL_SCHEMA)
