"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a vector of the word (hashed) and the mean of the vectors of its
character trigrams (hashed), projected once per distinct word. A forward and a backward
GRU read a window of words, attention pools their states, a logistic unit scores the
window. All overlapping windows of a text are scored; the text's score is the largest.

Training is on a bounded sample of labelled texts. A label holds for the text, not for
a window: each round takes, for every text, the window that scores highest now (a toxic
text has at least one toxic window, a clean one has none), first for short texts only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, sliced, without

WINDOW, STRIDE = 40, 20
WORDS, TRIGRAMS, WIDTH, HIDDEN, ATTENTION = 1 << 14, 1 << 13, 12, 8, 8
#: Bounds of the fitted sample: texts of either label, characters of a text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 2000, 4000
ROUNDS, RATE, BATCH = 12, 0.012, 64
THRESHOLD = 0.3
#: Words that a worker remembers, windows that are scored at once.
MAX_WORDS, SCORED = 150_000, 512

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover ``n`` words; one empty window for none."""
    return [(i, min(n, i + WINDOW)) for i in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def _inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, trigram buckets of all words in turn, and where each word's trigrams start."""
    crc = zlib.crc32
    own = np.array([crc(w) % WORDS for w in words], np.int64)
    flat, starts = [], []
    for w in words:
        starts.append(len(flat))
        w = b"<" + w + b">"
        flat += [crc(w[i : i + 3]) for i in range(len(w) - 2)]
    return own, np.array(flat, np.int64) % TRIGRAMS, np.array(starts, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Model:
    """Parameters; ``forward`` and ``step`` work on time-major arrays of both directions."""

    def __init__(self, seed: int = 3):
        rng, h = np.random.default_rng(seed), HIDDEN
        near = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
        self.p = {
            "word": near(WORDS, WIDTH), "tri": near(TRIGRAMS, WIDTH), "w": near(2 * WIDTH, 6 * h), "wb": np.zeros(6 * h, np.float32),
            "u": near(2, h, 3 * h), "a": near(2 * h, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "v": near(ATTENTION, 1),
            "o": near(2 * h, 1), "ob": np.full(1, -1, np.float32),
        }
        self.moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in self.p.items()}
        self.n = 0

    def features(self, own: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.concatenate((starts, [len(flat)])))
        tri = np.add.reduceat(self.p["tri"][flat], starts, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][own], tri), axis=1)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """``x`` [time, direction, window, 3 * hidden] with the second direction reversed; ``mask`` [time, window]; logits."""
        p, h_, steps = self.p, HIDDEN, len(x)
        h = np.zeros((2, x.shape[2], h_), np.float32)
        states, tape = np.empty((steps, *h.shape), np.float32), []
        both = np.stack((mask, mask[::-1]), axis=1)[..., None]
        full = bool(mask.all())
        for t in range(steps):
            g = np.matmul(h, p["u"])
            rz = x[t, :, :, : 2 * h_] + g[..., : 2 * h_]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            r, z = rz[..., :h_], rz[..., h_:]
            n = r * g[..., 2 * h_ :]
            n += x[t, :, :, 2 * h_ :]
            np.tanh(n, out=n)
            later = n + z * (h - n)
            if not full:
                later = np.where(both[t], later, h)
            if keep:
                tape.append((h, g, r, z, n))
            h = states[t] = later
        s = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)
        a = np.tanh(s @ p["a"] + p["ab"])
        e = np.where(mask, (a @ p["v"])[..., 0], -1e9)
        e = np.exp(e - e.max(axis=0)) * mask
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        c = (alpha[..., None] * s).sum(axis=0)
        return (c @ p["o"])[:, 0] + p["ob"][0], {"tape": tape, "s": s, "a": a, "alpha": alpha, "c": c, "both": both}

    def step(self, features: np.ndarray, parts: tuple, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> None:
        """One step of Adam on windows ``ids`` [window, time] into ``features`` of the words ``parts``."""
        p, h_, grad = self.p, HIDDEN, {}
        projected = features @ p["w"] + p["wb"]
        x = arranged(projected[ids])
        logit, k = self.forward(x, mask, keep=True)
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        grad["o"], grad["ob"] = k["c"].T @ d[:, None], d.sum(keepdims=True)
        dc = d[:, None] * p["o"][:, 0]
        da = (k["s"] * dc).sum(axis=2)
        ds = k["alpha"][..., None] * dc
        de = k["alpha"] * (da - (k["alpha"] * da).sum(axis=0))
        grad["v"] = np.einsum("twk,tw->k", k["a"], de)[:, None]
        dt = de[..., None] * p["v"][:, 0] * (1 - k["a"] ** 2)
        grad["a"], grad["ab"] = np.einsum("twh,twk->hk", k["s"], dt), dt.sum(axis=(0, 1))
        ds += dt @ p["a"].T
        dstates = np.stack((ds[..., :h_], ds[::-1, :, h_:]), axis=1)
        dx, du, dh = np.zeros_like(x), np.zeros_like(p["u"]), np.zeros_like(dstates[0])
        for t in range(len(x) - 1, -1, -1):
            h, g, r, z, n = k["tape"][t]
            dh = dh + dstates[t]
            on = k["both"][t]
            dn = dh * (1 - z) * (1 - n * n) * on
            dz = dh * (h - n) * z * (1 - z) * on
            dr = dn * g[..., 2 * h_ :] * r * (1 - r)
            dx[t] = np.concatenate((dr, dz, dn), axis=2)
            dg = np.concatenate((dr, dz, dn * r), axis=2)
            du += np.matmul(h.transpose(0, 2, 1), dg)
            dh = np.where(on, dh * z + np.matmul(dg, p["u"].transpose(0, 2, 1)), dh)
        grad["u"] = du
        back = np.concatenate((dx[:, 0], dx[::-1, 1]), axis=2).transpose(1, 0, 2).reshape(-1, 6 * h_)
        dp = np.zeros_like(projected)
        np.add.at(dp, ids.ravel(), back)
        grad["w"], grad["wb"] = features.T @ dp, dp.sum(axis=0)
        df = dp @ p["w"].T
        own, flat, starts = parts
        sizes = np.diff(np.concatenate((starts, [len(flat)])))
        grad["word"], grad["tri"] = np.zeros_like(p["word"]), np.zeros_like(p["tri"])
        np.add.at(grad["word"], own, df[:, :WIDTH])
        np.add.at(grad["tri"], flat, np.repeat(df[:, WIDTH:] / sizes[:, None].astype(np.float32), sizes, axis=0))
        self.n += 1
        rate = RATE * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n)
        for name, g in grad.items():
            m, v = self.moments[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[name] -= rate * m / (np.sqrt(v) + 1e-7)


def arranged(x: np.ndarray) -> np.ndarray:
    """[window, time, 6 * hidden] to [time, direction, window, 3 * hidden], the second direction reversed."""
    h = 3 * HIDDEN
    out = np.empty((x.shape[1], 2, x.shape[0], h), np.float32)
    out[:, 0] = x[:, :, :h].transpose(1, 0, 2)
    out[:, 1] = x[:, ::-1, h:].transpose(1, 0, 2)
    return out


def train(texts: list[bytes], labels: list[int], seed: int = 11) -> Model:
    """Fit on whole texts; without a text of either label the untrained model scores everything low."""
    model, rng = Model(), np.random.default_rng(seed)
    if not any(labels):
        model.p["ob"][0] = -4
        return model
    # Some texts without words, so that their score is learned as well.
    texts, labels = [*texts, *[b""] * 20], [*labels, *[0] * 20]
    split = [words_of(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws), 1)}
    parts = _inputs([b" ", *vocabulary])
    y = np.array(labels, np.float32)
    ids, owner = [], []
    for d, ws in enumerate(split):
        line = [vocabulary[w] for w in ws]
        for a, b in windows_of(len(line)):
            ids.append(line[a:b] + [0] * (WINDOW - b + a))
            owner.append(d)
    ids, owner = np.array(ids), np.array(owner)
    first = np.searchsorted(owner, np.arange(len(split)))
    count = np.bincount(owner, minlength=len(split))
    for n in range(ROUNDS):
        docs = np.flatnonzero(count <= (2 if n < 2 else 1 << 30))
        if len(docs) < 50:
            docs = np.arange(len(split))
        some = np.flatnonzero(np.isin(owner, docs))
        scores = np.full(len(owner), -np.inf)
        projected = model.features(*parts) @ model.p["w"] + model.p["wb"]
        for k in range(0, len(some), 2048):
            at = some[k : k + 2048]
            scores[at] = model.forward(arranged(projected[ids[at]]), ids[at].T > 0)[0]
        best = np.array([first[d] + scores[first[d] : first[d] + count[d]].argmax() for d in docs])
        other = np.array([first[d] + rng.integers(count[d]) for d in docs if not y[d]], int)
        pool = rng.permutation(np.concatenate((best, other)))
        for k in range(0, len(pool), BATCH):
            at = pool[k : k + BATCH]
            used, again = np.unique(ids[at], return_inverse=True)
            own, flat, starts = parts
            sizes = np.diff(np.concatenate((starts, [len(flat)])))[used]
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            pick = np.repeat(starts[used] - begin, sizes) + np.arange(sizes.sum())
            mine = own[used], flat[pick], begin
            model.step(model.features(*mine), mine, again.reshape(len(at), WINDOW), ids[at].T > 0, y[owner[at]])
    return model


class Scorer:
    """Scores whole texts; remembers the projected inputs of words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((MAX_WORDS, 6 * HIDDEN), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        m = self.model
        at = len(self.rows) + 1
        self.table[at : at + len(words)] = m.features(*_inputs(words)) @ m.p["w"] + m.p["wb"]
        self.rows.update(zip(words, range(at, at + len(words))))

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Table rows of a part of a text (at most 4096 words)."""
        found = list(map(self.rows.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, i in zip(words, found) if i is None))
            if len(self.rows) + len(new) + 1 > MAX_WORDS:
                self.rows.clear()
                new = list(dict.fromkeys(words))
            self._learn(new)
            found = list(map(self.rows.get, words))
        return np.array(found, np.int32)

    def score(self, texts: Iterator[bytes | None]) -> Iterator[float]:
        """In order. Windows of several texts are scored together, those of a long text in turn."""
        queue: list[np.ndarray] = []
        best: list[float] = []
        owners: list[int] = []
        done = 0

        def flush() -> None:
            width = max(1, max(len(q) for q in queue))
            x = np.zeros((len(queue), width, 6 * HIDDEN), np.float32)
            mask = np.zeros((width, len(queue)), bool)
            for k, q in enumerate(queue):
                x[k, : len(q)] = q
                mask[: len(q), k] = True
            logits = self.model.forward(arranged(x), mask)[0]
            for d, s in zip(owners, logits.tolist()):
                best[d] = max(best[d], s)
            queue.clear()
            owners.clear()

        for text in texts:
            words = words_of(text)
            best.append(-np.inf)
            for begin in range(0, max(1, len(words) - (WINDOW - STRIDE)), STRIDE * 100):
                part = words[begin : begin + STRIDE * 100 + WINDOW - STRIDE]
                inputs = self.table[self.ids(part)] if part else self.table[:0]
                for a, b in windows_of(len(part)):
                    queue.append(inputs[a:b])
                    owners.append(len(best) - 1)
                    if len(queue) == SCORED:
                        flush()
            if len(best) >= 4096:
                if queue:
                    flush()
                yield from (float(s) for s in _sigmoid(np.array(best)))
                done += len(best)
                best.clear()
        if queue:
            flush()
        yield from (float(s) for s in _sigmoid(np.array(best)))


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """A model of the labelled rows outside the held-out fold; see the bounds above.

    An id labelled several times is toxic if any of its labels says so; null labels and
    ids are not used. The rows with the smallest hash of the id are taken.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold("doc_id", folds) != held)
    short = docs.select("doc_id", F.length("text").alias("n")).where(F.col("n").between(1, SAMPLE_CHARS))
    able = known.join(short.select("doc_id"), "doc_id", "left_semi")
    take = lambda v, n: able.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    ids = {r.doc_id: int(r.toxic) for v, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in take(v, n)}
    rows = docs.where(F.col("doc_id").isin(list(ids))).where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text")
    # Of an id with several texts the least one is taken.
    texts = sorted((r.doc_id, r.text) for r in rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    return train([t.encode() for _, t in texts], [ids[i] for i, _ in texts])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, then ``score``. A null or empty text has the score of a window without words."""
    model.moments = {}
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = without(docs, text, "score")
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in sliced(batches):
            found = pa.array(list(scorer.score(iter(byte_values(b, text)))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), found], schema.names)

    return docs.select(*names, text).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row of ``docs``; other columns are not read.

    Repeated rows stay. A null doc_id is not held out and not learned from; neither are
    null labels, null and empty texts, or labels whose id no document has. A null or empty
    text has the score of a window without words; long texts are scored whole. Without
    labels every score is low; without documents the result is empty.
    """
    own = docs.select("doc_id", "text")
    found = score(own, fit(own, labels))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
