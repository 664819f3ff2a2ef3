"""Benchmark decontamination: a prefix-filtered set join of benchmark windows and documents.

A window is a run of 13 consecutive words of an item (all its words if it has fewer).
A document contains a window only if it contains all its words, so one word of the
window is a sufficient prefix. Words are ordered by rarity: their occurrences in all
documents are counted, and each window is indexed under its rarest word, with that
word's offset. A document's postings are its occurrences of indexed words, each with the
twelve words around it on either side. Postings and index are joined on the word. The
offset fixes where the window would start; windows that would start before the first word
or end after the last are dropped (position and length bound); the rest are verified word
by word in the posting's surroundings. So texts are read once and never shuffled.

A word with more than a small part of all occurrences is dealt over as many salts as
keep each below that part. Words are sought by a set of them, or, where that is too large
to be sent to every task, by a bit map of bounded size, whose false positives the join removes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_values, fresh, materialize, parted, sliced

WINDOW_WORDS = 13
#: Bytes of a set of words that is sent to every task; a larger one is sent as a bit map of this size.
SIEVE_BYTES = 16 << 20
#: A word with over this part of the occurrences of all indexed words is dealt over salts; so at most this many words are.
HOT_PARTS, HOT_LEAST = 4096, 50_000

_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z in lower case, runs of digits, a-z and characters beyond ASCII."""
    return (text or b"").translate(_WORDS).split()


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows: ``window`` (words joined by spaces), ``n`` words, ``classes`` (ids of the texts that have it).

    Items with the same words are one class, whatever their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for line in byte_values(b, "words"):
                w = line.split()
                n = min(size, len(w))
                found = sorted({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)})
                key = hashlib.sha256(line).hexdigest()[:24]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array([n] * len(found), pa.int32()), pa.array([key] * len(found))], ["window", "n", "class"])

    known = membership(items, item_id, text).select("words").distinct()
    each = known.mapInArrow(run, "window string, n int, class string")
    return each.groupBy("window", "n").agg(F.sort_array(F.collect_set("class")).alias("classes"))


def membership(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id`` (string), ``class``, ``words`` of every item with an id and at least a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [b" ".join(words_of(x)) for x in byte_values(b, "text")]
            keys = [hashlib.sha256(x).hexdigest()[:24] for x in lines]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.binary()).cast(pa.string()), pa.array(keys)], ["item_id", "words", "class"])

    own = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return own.where("item_id is not null").mapInArrow(run, "item_id string, words string, class string").where("words <> ''")


class Sieve:
    """Tells of words whether they may be among ``vocabulary(word)``."""

    def __init__(self, vocabulary: DataFrame):
        n = vocabulary.agg(F.count("*").alias("n"), F.sum(F.octet_length("word") + 50).alias("b")).first()
        self.exact = (n.b or 0) <= SIEVE_BYTES
        if self.exact:
            self.words = frozenset(r.word.encode() for r in vocabulary.collect())
            return
        self.mask = min(1 << (16 * n.n).bit_length(), 8 * SIEVE_BYTES) - 1
        slots = vocabulary.select((F.crc32(F.encode("word", "UTF-8")).bitwiseAND(F.lit(self.mask))).alias("s")).distinct()
        self.bits = np.zeros((self.mask >> 3) + 1, np.uint8)
        for r in slots.groupBy(F.expr("s div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(s % 8 as int))")).alias("v")).toLocalIterator():
            self.bits[r["at"]] = r.v

    def __contains__(self, word: bytes) -> bool:
        if self.exact:
            return word in self.words
        at = zlib.crc32(word) & self.mask
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def test(self):
        return self.words.__contains__ if self.exact else self.__contains__


def sieve(vocabulary: DataFrame) -> Broadcast:
    return vocabulary.sparkSession.sparkContext.broadcast(Sieve(vocabulary))


def word_counts(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in all documents of each word of ``vocabulary(word)``: ``word``, ``total``. Tasks count before the shuffle."""
    only = sieve(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = only.value.test()
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "total"])

        for b in sliced(batches):
            for x in byte_values(b, text):
                seen.update(filter(known, words_of(x)))
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        yield out()

    counts = docs.select(text).mapInArrow(run, "word string, total long").groupBy("word").agg(F.sum("total").alias("total"))
    return vocabulary.join(counts, "word", "left").select("word", F.coalesce("total", F.lit(0)).alias("total"))


def prefix_index(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """``windows`` with ``word`` (the rarest; ties by the word, then the first), its ``total`` and its ``offset``."""
    split = found.select("window", F.posexplode(F.split("window", " ")).alias("at", "word"))
    counts = word_counts(docs, text, split.select("word").distinct())
    order = F.struct("total", "word", "at")
    rarest = split.join(counts, "word").groupBy("window").agg(F.min(order).alias("r"))
    return found.join(rarest, "window").select("window", "n", "classes", F.col("r.word").alias("word"), F.col("r.total").alias("total"), F.col("r.at").alias("offset"))


def postings(docs: DataFrame, only: Broadcast, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs``, then ``n_words`` and ``postings``: array<struct<word, at, before, around>> of words in the sieve.

    ``around`` has the words around the place ``at``, ``before`` of them before it.
    """
    more = WINDOW_WORDS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = only.value.test()
        for b in sliced(batches, 256):
            sizes, counts, words_, ats, befores, arounds = [], [0], [], [], [], []
            for x in byte_values(b, text):
                words = words_of(x)
                sizes.append(len(words))
                for at in [i for i, w in enumerate(words) if known(w)]:
                    before = min(at, more)
                    words_.append(words[at])
                    ats.append(at)
                    befores.append(before)
                    arounds.append(b" ".join(words[at - before : at + more + 1]))
                counts.append(len(ats))
            each = [pa.array(words_, pa.binary()).cast(pa.string()), pa.array(ats, pa.int64()), pa.array(befores, pa.int32()), pa.array(arounds, pa.binary()).cast(pa.string())]
            found = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(each, ["word", "at", "before", "around"]))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(sizes, pa.int64()), found], [*keep, "n_words", "postings"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, n_words long, postings array<struct<word:string,at:bigint,before:int,around:string>>")


def hits(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Occurrences of windows in ``rows(key, postings)``: ``key``, ``start``, ``n`` (words), ``classes``."""
    each = rows.select("key", F.explode("postings").alias("p")).select("key", "p.word", "p.at", "p.before", "p.around")
    totals = index.select("word", "total").distinct()
    most = max(HOT_LEAST, (totals.agg(F.sum("total").alias("s")).first().s or 0) // HOT_PARTS)
    # Totals over 1/HOT_PARTS of their sum: HOT_PARTS words at most.
    hot = totals.where(F.col("total") > most).select("word", F.ceil(F.col("total") / most).cast("int").alias("parts"))
    salted = lambda df, salt: df.join(F.broadcast(hot), "word", "left").withColumn("salt", salt).drop("parts")
    parts = F.coalesce("parts", F.lit(1))
    left = salted(each, F.pmod(F.xxhash64("key", "at"), parts).cast("int"))
    right = salted(index.drop("total"), F.explode(F.sequence(F.lit(0), parts - 1)))
    met = left.join(right, ["word", "salt"]).where("at >= offset and before >= offset")
    found = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("window")
    return met.where(found).select("key", (F.col("at") - F.col("offset")).alias("start"), "n", "classes")


def covered(found: DataFrame) -> DataFrame:
    """Of ``hits`` per key: ``n_hit`` (words in any of them), ``longest`` (words of the longest window), ``classes`` (sorted, comma-joined)."""
    order = Window.partitionBy("key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    new = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(order), F.lit(0))), F.lit(0).cast("long"))
    each = found.select("key", "start", "n").distinct().withColumn("new", new)
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("classes"))))
    return each.groupBy("key").agg(F.sum("new").alias("n_hit"), F.max("n").alias("longest")).join(found.groupBy("key").agg(F.array_join(names, ",").alias("classes")), "key")


def find(docs: DataFrame, items: DataFrame, keep: list[str], item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of ``docs(key, text, ..)`` the rows with ``n_words``, and what ``covered`` tells of each key that is hit."""
    found = materialize(windows(items, item_id, item_text), "windows")
    index = materialize(prefix_index(docs, "text", found), "prefix-index")
    rows = materialize(postings(docs, sieve(index.select("word").distinct()), keep), "postings")
    return rows.drop("postings"), covered(materialize(hits(rows, index), "window-hits"))


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A null text, in either table, has no words; so do empty ones. Items without words,
    and items without an id, match nothing. Repeated items with one id count once.
    Repeated documents give repeated rows, a null doc_id stays null. With an empty
    benchmark nothing is hit; without documents the result is empty. Only the named
    columns are read, so others cannot clash. Item ids are looked up once per distinct
    set of matching texts, not per document.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("key"))
    rows, hit = find(own, items, ["doc_id", "key"])
    rows = rows.join(hit, "key", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("classes", F.lit("")).alias("classes"))
    rows = materialize(rows, "decontamination-rows")
    sets = rows.where("classes <> ''").select("classes").distinct()
    each = sets.select("classes", F.explode(F.split("classes", ",")).alias("class"))
    ids = each.join(membership(items).select("class", "item_id").distinct(), "class").groupBy("classes")
    ids = ids.agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    ids = ids.select("classes", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("sha"))
    key = F.when(F.col("classes") != "", F.col("classes")).otherwise(F.concat(F.lit("none:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (
        rows.withColumn("key", key)
        .join(ids.withColumnRenamed("classes", "key"), "key", "left")
        .select("doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"))
        .withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows; all columns, also clashing ones.

    A row goes if it holds a whole window of 13 words of an item, however long the text
    around it is, or if windows cover a twentieth of its words; items of fewer words say
    too little to count alone. Null and empty texts stay; rows with equal texts stay or
    go together. With an empty benchmark all stay; an empty table gives an empty result.
    Decisions are made per distinct text, and only rows whose key may be that of a
    contaminated text are shuffled for the join with those keys.
    """
    (name,) = fresh(docs, "key")
    key = F.sha2(F.col(text), 256)
    own = docs.select(key.alias("key"), F.col(text).alias("text")).where("text is not null")
    rows, hit = find(own, items, ["key"])
    bad = rows.join(hit, "key").where((F.col("longest") >= WINDOW_WORDS) | _contaminated(F.col("n_hit"), F.col("n_words")))
    bad = materialize(bad.select(F.col("key").alias(name)).distinct(), "contaminated")
    maybe, rest = parted(docs.withColumn(name, key), bad, name)
    return maybe.join(bad, name, "left_anti").unionByName(rest).select(*docs.columns)
