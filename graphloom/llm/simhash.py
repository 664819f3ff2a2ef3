"""SimHash near-duplicates: byte-position inverted index, count filter, verification.

Fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes,
so they share at least 4 positional bytes: 4 is the guaranteed minimum of the
count filter. A posting list for one positional byte holds 1/256 of all
fingerprints and its pairs grow with the square of the input, so the index keeps
lists for conjunctions: of any 7 positions at least 3 agree, hence every link
meets in one of the C(7,3) = 35 lists keyed by three positional bytes (beyond
2^27 fingerprints: one of the C(8,4) = 70 lists keyed by four). In a list the
shared positional bytes of a pair are tallied, pairs below the minimum are
dropped, the rest are verified by their differing bits. A list longer than
``CHUNK`` is split into blocks and every pair of blocks becomes a task-sized group
of its own, so no list is cut short; a group returns a spanning forest of its links,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, connected_components, fresh, materialize, sliced

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
MIN_SHARED_BYTES = 8 - MAX_BITS
CHUNK = 2048
WIDE_FROM = 1 << 27

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_AT = np.arange(0, 2048, 256)


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 for null and for texts without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    size = min(size, len(words))
    starts = np.concatenate(([0], spaces + 1))[: len(words) - size + 1].tolist()
    ends = np.concatenate((spaces, [len(joined)]))[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])])
        h = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        if len(h) < 400:
            ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
        else:
            ones += (np.bincount((h + _AT).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``fp`` bigint, row by row."""
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = pa.array([fingerprint(x) for x in byte_values(b, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), fps], [*keep, "fp"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def _linked(x: np.ndarray) -> np.ndarray:
    """Of XORs of pairs: enough equal positional bytes, then few enough differing bits."""
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= MIN_SHARED_BYTES
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def _forest(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among ``fps`` (distinct, uint64)."""
    left = fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            ok = _linked(left ^ x)
            if ok.any():
                found, left = left[ok], left[~ok]
                yield np.full(len(found), x), found
                frontier.extend(found)


def _links(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among equal neighbouring keys; runs of over 32 go through ``_forest``."""
    cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    starts = np.concatenate(([0], cuts))
    lengths = np.diff(np.concatenate((starts, [len(key)])))
    out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    run = np.repeat(np.arange(len(starts)), lengths)
    short = np.repeat((lengths > 1) & (lengths <= 32), lengths)
    run, some = run[short], fps[short]
    for step in range(1, 32):
        if len(some) <= step:
            break
        at = np.flatnonzero(run[step:] == run[:-step])
        if not len(at):
            break
        ok = at[_linked(some[at] ^ some[at + step])]
        out_a.append(some[ok])
        out_b.append(some[ok + step])
    for s, n in zip(starts[lengths > 32], lengths[lengths > 32]):
        for a, b in _forest(np.unique(fps[s : s + n])):
            out_a.append(a)
            out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, c1, c2); the last group of a batch waits for the next batch."""

    def found(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _links(key, fps)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys, fps = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        keys, fps = np.concatenate((keys, key)), np.concatenate((fps, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(keys):
            continue
        last = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0]) if (keys[0] != keys[-1]).any() else 0
        if last:
            yield found(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield found(keys, fps)


def links(fps: DataFrame, wide: bool = False) -> DataFrame:
    """Links among distinct ``fp`` values, enough of them to connect whatever links connect: ``a``, ``b``."""
    positions, size = (8, 4) if wide else (7, 3)
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    lists = []
    for n, combo in enumerate(combinations(range(positions), size)):
        value = F.lit(n).cast("long")
        for i in combo:
            value = F.shiftleft(value, 8).bitwiseOR(byte[i])
        lists.append(value)
    postings = fps.select("fp", F.explode(F.array(*lists)).alias("k"))
    long_lists = postings.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    parts = F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        postings.join(long_lists, "k", "left")
        .select("k", "fp", parts.alias("parts"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("k", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), "fp")
    )
    return dealt.repartition("k", "c1", "c2").sortWithinPartitions("k", "c1", "c2").mapInArrow(_search, "a long, b long").distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate groups: ``doc_id``, ``fp`` bigint, ``component_id`` (smallest id reachable by links).

    One row per row of ``docs``; other columns of ``docs`` are not looked at, so
    names among them cannot clash. Null or wordless texts have fingerprint 0 and
    link with each other like any others. Equal fingerprints are one node of the
    index, however many rows have them. A null id stays null and is never the
    smallest; a group of null ids only has a null ``component_id``. Repeated rows
    and repeated ids are kept as they are. An empty table gives an empty result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(fingerprints(own), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fps")
    edges = links(distinct.select("fp"), distinct.count() > WIDE_FROM)
    roots = connected_components(edges, "simhash-cc").withColumnRenamed("node", "fp")
    grouped = distinct.join(roots, "fp")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("group_id"))
    linked = grouped.join(least, "root").select("fp", "group_id")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("group_id", "first_id").alias("component_id"))
    return rows.join(materialize(named, "simhash-groups"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Ties (rows that repeat an id within a group) are settled by the text's hash, and
    identical rows by taking one. All columns are returned. Groups are decided on
    (id, text hash), so the texts move once, in the final join.
    """
    sign = F.xxhash64(F.col(text))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), sign.alias("sign"))
    rows = materialize(fingerprints(own), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sign"))
    distinct = materialize(rows.groupBy("fp").agg(first.alias("first")), "distinct-fps")
    edges = links(distinct.select("fp"), distinct.count() > WIDE_FROM)
    roots = connected_components(edges, "simhash-cc").withColumnRenamed("node", "fp")
    kept = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.col("first.doc_id").alias("id"), F.col("first.sign").alias("sign")).distinct(), "simhash-kept")
    # One key for the join and for taking one of identical rows: the texts are shuffled once.
    (name,) = fresh(docs, "key")
    key = lambda i, s: F.concat(F.when(i.isNull(), ":").otherwise(F.concat(i.cast("string"), F.lit(":"))), s.cast("string"))
    chosen = docs.withColumn(name, key(F.col(doc_id), sign))
    wanted = kept.select(key(F.col("id"), F.col("sign")).alias(name))
    return chosen.join(wanted, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
