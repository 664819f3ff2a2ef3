"""Shared pieces of the training-data operators.

* ``shared_dir`` / ``materialize``: lineage is cut with Parquet tables in the
  folder named by ``spark.checkpoint.dir``, which every executor sees.
* ``parted``: rows whose key may be among given keys, apart from the rest, without a shuffle.
* ``connected_components``: distributed alternating star contraction.
* ``byte_values``: UTF-8 bytes of a string column of an Arrow batch.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a map of keys for each key, as far as the whole map stays within 2^27 bits (16 MB), and bits of one of its rows.
KEY_BITS, MAP_BITS, ROW_BITS = 64, 1 << 27, 1 << 15

_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on ``local[..]`` masters that name none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Table:
    """A written intermediate table; ``df`` reads it, ``drop`` removes its files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/graphloom/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _TABLES.append((self.spark, self.path))

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _TABLES.remove((self.spark, self.path))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; files go when the interpreter ends."""
    return Table(df, name).df


@atexit.register
def release_tables() -> None:
    """Delete every table written by ``materialize`` so far."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the cluster owns the folder's clean-up
            return


def byte_values(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that a worker holds the Python objects of a few rows; frees Arrow's spare memory at the end."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    pa.default_memory_pool().release_unused()


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` that are none of ``names``, in whatever case: those names are for a result's columns."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def prefix_sums(sizes: Column) -> Column:
    """For each element of an array of longs the sum of those before it.

    Appending to an array copies it, so sums run over pieces of about the root of its size.
    """
    none = F.array().cast("array<bigint>")
    piece = F.greatest(F.ceil(F.sqrt(F.size(sizes))), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(sizes) / piece).cast("int"), F.lit(1)) - 1), lambda i: F.slice(sizes, i * piece + 1, piece))

    def run(of: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), none.alias("out"))
        return F.aggregate(of, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    zero = F.lit(0).cast("long")
    begins = run(F.transform(pieces, lambda p: F.aggregate(p, zero, lambda s, x: s + x)), zero)
    return F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), begins.alias("b")), lambda z: run(z["p"], z["b"])))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have, whatever its columns are called."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any(mark + n.lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def parted(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: the rows whose string ``key`` may be in ``keys(key)``, and those whose key is not.

    So a join with few keys need not shuffle all rows. A bit map of the keys' checksums
    is sent to every task, at most ``MAP_BITS`` whatever the number of keys; beyond that
    more rows only seem to match, and the join of the first part settles them. Null keys
    are in the second part. ``df`` is computed once for each part.
    """
    n = keys.count()
    bits = min(max(1 << (KEY_BITS * n).bit_length(), ROW_BITS), MAP_BITS)
    row, bitmap = fresh(df, "row", "bitmap")
    bit = F.crc32(F.encode(key, "UTF-8")).bitwiseAND(F.lit(bits - 1))
    at = F.pmod(bit, F.lit(ROW_BITS)).cast("int")
    maps = keys.select(key).groupBy((bit / ROW_BITS).cast("int").alias(row)).agg(F.bitmap_construct_agg(at).alias(bitmap))
    # MAP_BITS / ROW_BITS rows of ROW_BITS at most.
    joined = df.withColumn(row, (bit / ROW_BITS).cast("int")).join(F.broadcast(maps), row, "left")
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))
    return joined.where(known).select(*df.columns), joined.where(~known).select(*df.columns)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest node reachable from each node of ``edges(a bigint, b bigint)``; columns ``node``, ``root``.

    Alternating large-star and small-star steps. Each step takes the minimum of a
    node's neighbours (partial aggregation before the shuffle, so hubs do not
    concentrate rows) and joins it back; AQE can split a hub's side of that join.
    A round is written as a table, so a lost executor never replays the loop.
    Stops when a round leaves the edges as they were (by their number and the sum of
    their hashes): then every edge points at the smallest node. Nodes without an
    edge, or only with loops to themselves, have no row.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = Table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    sign = lambda t: t.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = sign(now)
    while before[0]:
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = Table(large.where("u <> v").distinct(), name)
        lower = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        later = Table(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), name)
        large.drop()
        now.drop()
        now, after = later, sign(later)
        if after == before:
            break
        before = after
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
