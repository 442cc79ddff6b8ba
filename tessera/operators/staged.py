"""Written stages in the shared folder: they cut long plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that spark.checkpoint.dir names; a folder of this machine only where Spark runs on it alone."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        scratch_path.own = getattr(scratch_path, "own", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
        folder = scratch_path.own
    return f"{folder.rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Within the block, only tables whose rows were measured while the query runs are broadcast.

    The sizes that Spark plans with are those of files. Tables of like pages are many times as large in memory, and the
    driver would gather and send them.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (static, adaptive)}
    try:
        spark.conf.set(adaptive, before[adaptive] or spark.conf.get(static))
        spark.conf.set(static, "-1")
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table; see ``measured_joins``."""
    path = scratch_path(df.sparkSession, name)
    with measured_joins(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by its key to as many tasks as there are partitions of a shuffle: Spark would join those of few bytes, however long Python works on them."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *key)
