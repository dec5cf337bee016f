"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the audits rely on.

    Timestamps are UTC.  Generated methods above 8000 bytes are left to Spark's split
    projections, because the JVM never compiles larger ones: the one-pass measures of a
    profile ran at half the speed without this.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``.  In local mode, as in tests,
    a temporary one is made where none is set; a cluster without one is refused, as its
    executors would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="dqspark-"))
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Write a derived table to the checkpoint folder and go on from there.

    Used for small tables (a row per audited column or rule) that several later steps
    read, so that the scans behind them run once and survive a lost executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def together(spark: SparkSession, *jobs: Callable) -> list:
    """Results of jobs that do not need each other, submitted at once so that one fills the gaps of another."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a pinned table if it has at most ``rows`` rows, else join it by shuffle.

    The rows joined this way hold keys and a few numbers, so the bound is some 20 MB.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
