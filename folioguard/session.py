"""Session settings the jobs rely on, and the shared folder for cut lineage and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def build_session(app: str = "folioguard", master: str | None = None, **conf: str) -> SparkSession:
    """Session for scripts and tests; a cluster brings its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a scratch one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    scratch = os.environ.get("FOLIOGUARD_SCRATCH") or tempfile.mkdtemp(prefix="folioguard-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def together(*jobs: Callable[[], T]) -> list[T]:
    """Run independent Spark jobs side by side, so that a small one need not wait for a large one."""
    with ThreadPoolExecutor(max_workers=max(len(jobs), 1)) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Cut lineage by writing a Parquet table below the shared folder and reading it back.

    A lost executor then costs a re-read of its splits instead of the whole upstream job. Tables in a ``folder``
    below the shared one can be discarded together.
    """
    spark = df.sparkSession
    path = f"{folder}/{label}-{uuid.uuid4().hex}" if folder else staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of staged tables once all that is made of them is written; else they stay on disk."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
