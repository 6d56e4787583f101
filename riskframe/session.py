"""Session settings the jobs rely on, and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

# Results that reach the driver are summaries; a summary above this many rows is refused.
DRIVER_ROWS = 200_000


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="riskframe-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, read from the session.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


# Folders of the jobs that run, the innermost last.
_jobs: list[str] = []


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/riskframe/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return "/".join([_root(spark), *_jobs, f"{name}-{uuid.uuid4().hex}"])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete what this application staged. Results that still read a staged table end with it."""
    _delete(spark, _root(spark))


@contextmanager
def job_scratch(spark: SparkSession):
    """Stage inside a folder of the job's own, deleted when the job ends; its results must be written by then."""
    _jobs.append(f"job-{uuid.uuid4().hex}")
    folder = "/".join([_root(spark), *_jobs])
    try:
        yield
    finally:
        _jobs.pop()
        _delete(spark, folder)


def stage_table(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Used where an intermediate is read by several jobs: the source is scanned once, lineage is cut,
    and a lost executor costs a re-read instead of a recomputation. With `by`, the table is laid out by a column
    of few values, so that a filter on it reads its own files only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


# Tables of more tasks than this by their rows get this many, and more only where a task would be too long.
ENOUGH_TASKS = 256
MOST_ROWS = 200_000


def spread(df: DataFrame, rows_per_task: int = 2_500) -> DataFrame:
    """Split a small table into tasks of `rows_per_task` rows, ahead of work that is long per row.

    The number of tasks depends on the rows alone, never on the machine, so fits that draw per partition
    repeat anywhere.
    """
    return sized(df, df.count(), rows_per_task)


def sized(df: DataFrame, rows: int, rows_per_task: int = 20_000) -> DataFrame:
    """Give a table of known size one task per `rows_per_task` rows, or `ENOUGH_TASKS` if those were more.

    Iterative training runs a job per step, so the number of tasks is much of the cost, and of what reaches the driver. A
    larger table is dealt as well, since its files may be few: a task gets at most `MOST_ROWS` rows.
    """
    tasks = max(1, -(-rows // rows_per_task))
    if tasks <= ENOUGH_TASKS:
        return df.repartition(tasks)
    tasks = max(ENOUGH_TASKS, -(-rows // MOST_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def collect_bounded(df: DataFrame, limit: int = DRIVER_ROWS) -> list:
    """Collect a summary table, refusing one that outgrew its bound (never truncating it)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"summary exceeds {limit} rows; it must stay a DataFrame")
    return rows


LOCAL_BYTES = 8 << 20


def local_if_small(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """A summary as a broadcast local table when it is small in rows and bytes, else the summary itself.

    Both are checked before the broadcast; a summary that outgrew them is joined by shuffle.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit or rows.nbytes > LOCAL_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
