"""File inventories, checksums and the ledger of finished files."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: signal file formats
SIGNAL_SUFFIXES = (".ccf5", ".blow5", ".slow5")


def list_files(spark: SparkSession, root: str, suffixes: Sequence[str] = SIGNAL_SUFFIXES) -> DataFrame:
    """Path, size and modification time of the matching files below ``root``; contents are not read.

    A scan leaves out files without a byte; :func:`empty_files` names those.
    """
    files = _binary(spark, root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return files.withColumn("extension", extension(F.col("path"))).where(F.col("extension").isin(*suffixes))


def _binary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the files of size zero: those in the file index of the scan that its rows lack."""
    scan = _binary(spark, root)
    listed = [(plain_path(uri),) for uri in scan.inputFiles()]
    return spark.createDataFrame(listed, "path string").join(scan.select("path"), "path", "left_anti")


def plain_path(uri: str) -> str:
    """A file's name as the path column of a scan spells it."""
    return re.sub("^file:/+", "file:/", unquote(uri))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def _relative(path: Column, root: str) -> Column:
    clean = root.rstrip("/")
    return F.substring(path, F.instr(path, clean) + F.lit(len(clean) + 1), F.length(path))


def inventory(spark: SparkSession, root: str, suffixes: Sequence[str] = SIGNAL_SUFFIXES) -> DataFrame:
    """Files and bytes per first folder below ``root`` (``root`` for files at the top), with the extensions seen."""
    relative = _relative(F.col("path"), root)
    first = F.split_part(relative, F.lit("/"), F.lit(1))
    group = F.when(F.instr(relative, "/") > 0, first).otherwise(F.lit("root"))
    empty = empty_files(spark, root).select("path", F.lit(0).cast("long").alias("size"))
    empty = empty.withColumn("extension", extension(F.col("path"))).where(F.col("extension").isin(*suffixes))
    return (
        list_files(spark, root, suffixes)
        .drop("mtime")
        .unionByName(empty)
        .groupBy(group.alias("group"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size").alias("bytes"),
            F.array_sort(F.collect_set("extension")).alias("extensions"),
        )
    )


def discover(spark: SparkSession, path: str, suffixes: Sequence[str] = SIGNAL_SUFFIXES) -> DataFrame:
    """The matching files of a folder, or the file itself; nothing to read is an error."""
    files = list_files(spark, path, suffixes)
    if files.isEmpty():
        raise FileNotFoundError(f"no {', '.join(suffixes)} files in {path}")
    return files


#: Bytes of a file that are hashed at a time.
BLOCK = 8 << 20


def _opener(path: str) -> tuple[pa_fs.FileSystem, str]:
    """A file system of Arrow and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pa_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, inside = rest.lstrip("/").partition("/")
    store, _ = pa_fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, inside if scheme not in ("hdfs", "viewfs") else f"/{inside}"


def file_digest(path: str, block: int = BLOCK) -> str:
    """SHA-256 of a file of any size, read in blocks."""
    store, inside = _opener(path)
    found = hashlib.sha256()
    with store.open_input_stream(inside) as stream:
        while data := stream.read(block):
            found.update(data)
    return found.hexdigest()


def _streams(path: str) -> bool:
    try:
        return _opener(path) is not None
    except (pa.ArrowException, OSError, ValueError):
        return False


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256, path below ``root`` and size of every file; a file is hashed by one task, in blocks, whatever its size.

    A store that Arrow has no file system for is read by Spark, which holds a file in memory and takes up to 2 GB.
    """
    relative = _relative(F.col("path"), root).alias("path")
    files = _binary(spark, root)
    first = files.select("path").first()
    if first is not None and not _streams(first.path):
        full = files.select(F.sha2("content", 256).alias("sha256"), relative, F.col("length").alias("size"))
    else:

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.array([file_digest(p) for p in batch.column("path").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], ["path", "length", "sha256"])

        names = files.select("path", "length").repartition("path")
        hashed = names.mapInArrow(digests, "path string, length long, sha256 string")
        full = hashed.select("sha256", relative, F.col("length").alias("size"))
    empty = empty_files(spark, root).select(
        F.sha2(F.lit(b""), 256).alias("sha256"), relative, F.lit(0).cast("long").alias("size")
    )
    return full.unionByName(empty)


def write_checksums(sums: DataFrame, path: str) -> None:
    """``sha256  path`` lines, sorted by path."""
    sums.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value")).write.mode("overwrite").text(path)


def handoff_summary(sums: DataFrame) -> DataFrame:
    """Files and payload bytes per tier (first folder)."""
    tier = F.when(F.instr("path", "/") > 0, F.split_part("path", F.lit("/"), F.lit(1))).otherwise(F.lit("root"))
    return sums.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("payload_bytes"))


def config_hash(config: Mapping[str, object]) -> str:
    """Signature of a job's settings; any change makes earlier results stale."""
    return hashlib.sha256(json.dumps(dict(config), sort_keys=True, default=str).encode()).hexdigest()


def plan_incremental(files: DataFrame, ledger: DataFrame, signature: str) -> DataFrame:
    """Files without a complete ledger entry of the same settings, size and modification time."""
    done = ledger.where((F.col("status") == "complete") & (F.col("config_hash") == signature))
    return files.join(done.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
