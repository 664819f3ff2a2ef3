"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that every executor may get a copy of, and bytes (as the planner estimates them) of a part of a large one.
FEW_ROWS, PART_BYTES = 500_000, 4 << 20


def shared_folder(spark: SparkSession) -> None:
    """Make sure checkpoints go to the shared folder; a temporary one only in local mode without a setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder by columns, compressed, and read again: for tables that are read often or in part."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows, to be joined without moving the other side where it is small."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over as many parts as its size asks for, so that a task's share doesn't grow with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = df.sparkSession.sparkContext.defaultParallelism
    # Of rows that were computed before the size is unknown and told as the largest number.
    known = size < 1 << 50
    parts = max(least, math.ceil(size / PART_BYTES)) if known else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)
