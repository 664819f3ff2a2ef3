"""Near-duplicate embeddings through an inverted multi-index.

Each half of the (unit length) vectors has a codebook of its own; a pair of codes is a
cell of a product grid, and every vector is indexed in the cell of its nearest codes.
Each vector visits the cells nearest to it in the order of the multi-sequence traversal
(ascending sum of the halves' distances) until the target recall: the number of cells
is fitted so that, of vectors turned away from sampled ones by exactly the threshold's
angle, the target share lies in visited cells. Closer pairs are found more often, and a
pair needs only one of its two directions. Found pairs are verified in double precision.

Equal vectors are one class with a count. Members and visitors meet by first code;
codes with many members or visitors are dealt in blocks, every member block meeting
every visitor block, so that no task's group grows with a hot cell. A task returns counts of
links and a spanning forest of each block's links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

THRESHOLD = 0.9
#: The fitted part: sampled vectors, codes per half (for about CELL_VECTORS vectors a cell), recall at the threshold.
SAMPLE = 16384
SAMPLE_BYTES = 128 << 20
MAX_CODES = 8192
CELL_VECTORS = 12
TARGET_RECALL = 0.98
MEMBERS, VISITORS, ROWS = 4096, 16384, 1024


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(8):
        own = _distances(x, codes).argmin(axis=1)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


@dataclass
class Grid:
    """Two codebooks and the number of cells that each vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @staticmethod
    def fit(sample: np.ndarray, total: int) -> Grid:
        """``sample``: unit vectors; ``total``: how many vectors there are."""
        rng, dim = np.random.default_rng(5), sample.shape[1]
        cut = max(1, dim // 2)
        k = int(np.clip(round((total / CELL_VECTORS) ** 0.5), 1, min(MAX_CODES, len(sample))))
        grid = Grid(_codebook(sample[:, :cut], k, rng), _codebook(sample[:, cut:], k if dim > cut else 1, rng), 1)
        near = sample[:1000]
        turned = rng.normal(size=near.shape)
        turned -= (turned * near).sum(axis=1, keepdims=True) * near
        length = np.sqrt((turned * turned).sum(axis=1, keepdims=True))
        far = THRESHOLD * near + (1 - THRESHOLD**2) ** 0.5 * turned / np.where(length > 0, length, 1)
        (a, b), (c, d) = grid.halves(near), grid.halves(far)
        at = np.arange(len(near))
        reach = a[at, c.argmin(axis=1)] + b[at, d.argmin(axis=1)]
        ranks = [int(np.searchsorted(np.sort(x), r - y, side="left").sum()) for x, y, r in zip(a, b, reach)]
        grid.visits = min(int(np.quantile(ranks, TARGET_RECALL, method="higher")) + 1, len(grid.first) * len(grid.second))
        return grid

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _distances(x[:, :cut], self.first), _distances(x[:, cut:], self.second)

    def visit(self, x: np.ndarray) -> np.ndarray:
        """The cells (first code * number of second codes + second code) that each row visits; the own cell first.

        The visited cells are among the pairs of ranks (p, q) with (p+1)(q+1) <= visits.
        Rows are taken so many at once that their sums need about 64 MB.
        """
        n = max(1, int((1 << 23) // (self.visits * (1 + np.log(self.visits)) + len(self.first) + len(self.second))))
        return np.concatenate([self._visit(x[k : k + n]) for k in range(0, len(x), n)])

    def _visit(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        n = self.visits
        m1, m2 = min(n, a.shape[1]), min(n, b.shape[1])
        o1, o2 = np.argsort(a, axis=1, kind="stable")[:, :m1], np.argsort(b, axis=1, kind="stable")[:, :m2]
        p, q = np.array([(p, q) for p in range(m1) for q in range(min(m2, n // (p + 1)))]).T
        sums = np.take_along_axis(a, o1, 1)[:, p] + np.take_along_axis(b, o2, 1)[:, q]
        sums[:, 0] = -np.inf
        best = np.argsort(sums, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(o1, p[best], 1) * len(self.second) + np.take_along_axis(o2, q[best], 1)


def _usable(v: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of a few of the True cells that connect whatever all of them connect."""
    rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    link = link[np.ix_(rows, cols)]
    if int(link.sum()) <= 4 * (len(rows) + len(cols)):
        r, c = np.nonzero(link)
        return rows[r], cols[c]
    out_r, out_c = [], []
    new_r, new_c = np.ones(len(rows), bool), np.ones(len(cols), bool)
    for r in range(len(rows)):
        if not new_r[r]:
            continue
        new_r[r], wave = False, [r]
        while wave:
            x = wave.pop()
            for c in (found := np.flatnonzero(link[x] & new_c)):
                new_c[c] = False
                more = np.flatnonzero(link[:, c] & new_r)
                new_r[more] = False
                wave.extend(more.tolist())
                out_r.append(more)
                out_c.append(np.full(len(more), c))
            out_r.append(np.full(len(found), x))
            out_c.append(found)
    return rows[np.concatenate(out_r)], cols[np.concatenate(out_c)]


def _meet(kind: str, dim: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """Count and connect the links between the members and the visitors of one block."""

    def run(t: pa.Table) -> pa.Table:
        member = t.column("member").to_numpy(zero_copy_only=False).astype(bool)
        cid, copies = t.column("cid").to_numpy(), t.column("n").to_numpy()
        x, own = unit(_matrix(t.column("vec"), kind, dim)), t.column("own").to_numpy()
        cells = t.column("cells").combine_chunks()
        sizes, flat = np.diff(cells.offsets.to_numpy()), cells.flatten().to_numpy()
        at = np.repeat(np.arange(len(x)), sizes)
        names, place = np.unique(own, return_inverse=True)
        spot = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        hit = (names[spot] == flat) & member[at]
        slot = np.cumsum(member) - 1
        visited = np.zeros((int(member.sum()), len(names)), bool)
        visited[slot[at[hit]], spot[hit]] = True
        there = ~member[at]
        calls, callers = flat[there], at[there]
        order = np.argsort(calls, kind="stable")
        calls, callers = calls[order], callers[order]
        members = np.flatnonzero(member)
        members = members[np.argsort(own[members], kind="stable")]
        links, a, b = np.zeros(len(x), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for cell in np.unique(own[members]):
            lo, hi = np.searchsorted(own[members], (cell, cell + 1))
            ms = members[lo:hi]
            lo, hi = np.searchsorted(calls, (cell, cell + 1))
            for k in range(lo, hi, ROWS):
                qs = callers[k : min(hi, k + ROWS)]
                link = x[qs] @ x[ms].T >= THRESHOLD
                link &= cid[qs][:, None] != cid[ms]
                if not link.any():
                    continue
                links[qs] += link @ copies[ms]
                alone = link & ~visited[slot[ms]][:, place[qs]].T
                links[ms] += copies[qs] @ alone
                r, c = _forest(link)
                a.append(cid[qs[r]])
                b.append(cid[ms[c]])
        some = np.flatnonzero(links)
        a, b = np.concatenate(a), np.concatenate(b)
        none = np.full(len(a), 0)
        return pa.table({"a": np.concatenate((cid[some], a)), "b": np.concatenate((cid[some], b)), "links": np.concatenate((links[some], none))})

    return run


def _search(classes: DataFrame, total: int, kind: str, dim: int) -> DataFrame:
    """Rows (a, a, number of links) and edges (a, b, 0) among the classes of one dimension."""
    spark = classes.sparkSession
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    rows = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(size).collect()
    grid = Grid.fit(unit(np.frombuffer(b"".join(r.vec for r in rows), kind).reshape(-1, dim)), total)
    sent, width = spark.sparkContext.broadcast(grid), len(grid.second)
    shape = "member boolean, code int, own int, cells array<int>, cid long, n long, vec binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                b = whole.slice(begin, 2048)
                cells = sent.value.visit(unit(_matrix(b.column(2), kind, dim)))
                own = cells[:, 0]
                by_code = np.sort(cells, axis=1)
                code = by_code // width
                first = np.ones(cells.shape, bool)
                first[:, 1:] = code[:, 1:] != code[:, :-1]
                row = np.repeat(np.arange(len(cells)), first.sum(axis=1))
                flat = np.flatnonzero(first.ravel())
                n = cells.shape[1]
                offsets = np.concatenate((np.arange(len(cells)) * n, len(cells) * n + flat, [2 * len(cells) * n])).astype(np.int32)
                values = np.concatenate((by_code.ravel(), by_code.ravel())).astype(np.int32)
                take = pa.array(np.concatenate((np.arange(len(cells)), row)))
                arrays = [
                    pa.array(np.arange(len(take)) < len(cells)),
                    pa.array(np.concatenate((own // width, code.ravel()[flat])).astype(np.int32)),
                    pa.array(np.concatenate((own, own[row])).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    *(b.column(i).take(take) for i in (0, 1, 2)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["member", "code", "own", "cells", "cid", "n", "vec"])

    dealt = classes.select("cid", "n", "vec").mapInArrow(deal, shape)
    counts = dealt.groupBy("code").agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("visitors"))
    parts = counts.select("code", F.ceil(F.greatest("members", F.lit(1)) / MEMBERS).cast("int").alias("ms"), F.ceil(F.greatest("visitors", F.lit(1)) / VISITORS).cast("int").alias("vs"))
    parts = materialize(parts, "imi-parts")
    mine = lambda of: F.pmod(F.xxhash64("cid"), F.col(of)).cast("int")
    all_of = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    # One row per code of a codebook of at most MAX_CODES.
    blocks = dealt.join(F.broadcast(parts), "code")
    blocks = blocks.withColumn("mb", F.explode(F.when(F.col("member"), F.array(mine("ms"))).otherwise(all_of("ms"))))
    blocks = blocks.withColumn("vb", F.explode(F.when(F.col("member"), all_of("vs")).otherwise(F.array(mine("vs"))))).drop("ms", "vs")
    return blocks.groupBy("code", "mb", "vb").applyInArrow(_meet(kind, dim, width), "a long, b long, links long")


def components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id``, ``kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing and are their own component; so do vectors of different lengths among each
    other. Repeated vectors link with one another. Rows with equal ids stay rows of their
    own. A null id is never the smallest and keeps a null component if it is alone;
    ``kept`` compares nulls as equal. An empty table gives an empty result.
    """
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    kind = "<f4" if own.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        own = own.withColumn("embedding", F.col("embedding").cast("array<double>"))
    good = own.where(_usable(F.col("embedding")))
    grouped = good.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [np.asarray(v, kind).tobytes() for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(vecs, pa.binary())], ["embedding", "n", "first_id", "vec"])

    shape = own.select("embedding").schema.fields[0].dataType.simpleString()
    id_type = own.schema["vec_id"].dataType.simpleString()
    packed = grouped.mapInArrow(pack, f"embedding {shape}, n long, first_id {id_type}, vec binary")
    classes = materialize(packed.withColumn("cid", F.monotonically_increasing_id()), "imi-classes")
    found = None
    for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect():
        part = _search(classes.where(F.size("embedding") == r.dim), r["count"], kind, r.dim)
        found = part if found is None else found.unionByName(part)
    if found is None:
        linked = classes.select("embedding", F.lit(0).cast("long").alias("n_links"), F.col("first_id").alias("component_id"))
    else:
        found = materialize(found, "imi-links")
        counts = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
        roots = connected_components(found.where("a <> b").select("a", "b"), "imi-cc").withColumnRenamed("node", "cid")
        named = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        linked = named.join(least, "root").join(counts, "cid", "left")
        linked = linked.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = materialize(linked, "imi-result")
    rest = own.where(~_usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = good.join(linked, "embedding").select("vec_id", "n_links", "component_id").unionByName(rest)
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
