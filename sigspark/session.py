"""Session helpers: where shared intermediate data goes and how lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a temporary folder, because
    there driver and executors share one disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Staged tables of the job that this thread is running.
_STAGES: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("stages", default=None)


def own_stages(job: Callable) -> Callable:
    """A job that ends with its results written: what it staged on the way is deleted when it returns or fails.

    What it returns must not read staged tables.
    """

    @wraps(job)
    def run(*args, **options):
        made: list[tuple[SparkSession, str]] = []
        outer = _STAGES.set(made)
        try:
            return job(*args, **options)
        finally:
            _STAGES.reset(outer)
            for spark, path in made:
                discard(spark, path)

    return run


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor then never replays the sort or sampling behind it, and unlike a checkpointed DataFrame the table can be
    read column by column and has a size that the choice of joins can see.
    """
    path = scratch_path(df.sparkSession, "stage")
    stages = _STAGES.get()
    if stages is not None:
        stages.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by the file system that its path belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False, and nothing written, if it does."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = system.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one, through the file system that its path belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for jobs that are not submitted with it."""
    context = spark.sparkContext
    if getattr(context, "_sigspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "sigspark"
    context.addPyFile(shutil.make_archive(str(archive), "zip", root, "sigspark"))
    context._sigspark_shipped = True
