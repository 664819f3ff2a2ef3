"""Language identification by compression.

One zstandard raw-content dictionary per language, made from a bounded sample of
labelled texts. A text is put into lower case and everything but its letters becomes a space; then all
of it, in chunks, is compressed with each dictionary, and the language with the
smallest total is chosen. A narrow margin to the second smallest rejects the choice:
it is still returned, with ``rejected``. Sizes are whole bytes, so a margin counts as
narrow if it is so even when it is a byte larger than it seems.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, fresh, sliced, without

#: Bounds of the fitted sample: texts per language, characters per text, bytes per dictionary.
SAMPLE_TEXTS = 120
SAMPLE_TEXT_BYTES = 1500
DICTIONARY_BYTES = 32 << 10
CHUNK_BYTES = 2048
#: Parts in which the hashes of one language are ranked, before those that each part keeps are ranked together.
RANK_PARTS = 32
#: A choice whose size isn't smaller than the second by this part, less a byte for rounding, is rejected.
MIN_MARGIN = 0.002
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, bytes]:
    """Dictionaries by language, from the ``SAMPLE_TEXTS`` distinct labelled texts with the smallest hash of each language.

    Rows without a text or language are not used. Every language is learned, so the
    sample and the dictionaries grow with the number of languages. Hashes are ranked
    first, without the texts, in ``RANK_PARTS`` parts of a language and then over what the
    parts keep, so a language never has more than ``RANK_PARTS * SAMPLE_TEXTS`` rows in
    one task; only the chosen texts are read again.
    """
    own = labelled.select(F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null and length(t) > 0")
    own = own.withColumn("h", F.xxhash64(F.lit(17), "t"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    first = own.select("l", "h").distinct().withColumn("part", F.pmod("h", F.lit(RANK_PARTS)))
    first = first.withColumn("r", rank("l", "part")).where(F.col("r") <= SAMPLE_TEXTS)
    chosen = first.withColumn("r", rank("l")).where(F.col("r") <= SAMPLE_TEXTS).select("l", "h")
    # SAMPLE_TEXTS pairs of a language and a hash for each language.
    picked = own.join(F.broadcast(chosen), ["l", "h"]).select("l", "h", F.substring("t", 1, SAMPLE_TEXT_BYTES).alias("t"))
    parts: dict[str, list[bytes]] = {}
    for x in picked.groupBy("l", "h").agg(F.min("t").alias("t")).orderBy("l", "h").collect():
        parts.setdefault(x.l, []).append(prepared(x.t))
    return {k: b"".join(v)[:DICTIONARY_BYTES] for k, v in sorted(parts.items())}


_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def prepared(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


class Classifier:
    """Compressors of one set of dictionaries; built once per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            params = zstd.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=3, min_match=4, strategy=zstd.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether it is rejected."""
        shown = (text or b"").decode("utf-8", "replace")
        if not self.languages or not _LETTER.search(shown):
            return UNDETERMINED, 0.0, True
        whole = prepared(shown)
        chunks = [whole[i : i + CHUNK_BYTES] for i in range(0, len(whole), CHUNK_BYTES)]
        sizes = [sum([len(c.compress(x)) for x in chunks]) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        score = 1 / (1 + sum([math.exp(-50 * (s - sizes[best]) / s) for s in rest]))
        narrow = bool(rest) and min(rest) - sizes[best] + 1 <= MIN_MARGIN * min(rest)
        return self.languages[best], score, narrow


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """All columns of ``docs``, then ``lang_pred``, ``score``, ``rejected``.

    ``und`` with score 0, rejected, for a null text, one without letters, and if no
    language was learned. Equal sizes go to the first language by name. Row by row, so repeated rows stay. Result columns replace columns of
    ``docs`` with the same names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = without(docs, *(f.name for f in made))
    schema = T.StructType([docs.schema[c] for c in names] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for b in sliced(batches):
            found = [model.predict(x) for x in byte_values(b, text)]
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *arrays], schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def identify(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Fit on the rows whose fold of 5 isn't 0, classify all: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    A null doc_id is not held out and not learned from; neither are rows with a null
    language or a null or empty text. Repeated rows give repeated rows and are learned
    once. An empty table gives an empty result; without any row to learn from everything
    is ``und``. Only doc_id, text and lang are read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), "text", "lang")
    model = fit(own.where(fold("doc_id", 5) != 0))
    found = classify(own.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns as they were, ``lang`` too.

    Rows with a null text or one without letters go. Repeated rows stay or go together.
    An empty table gives an empty result.
    """
    model = fit(docs.where(fold(doc_id, 5) != 0), text, lang, doc_id)
    made = ("lang_pred", "score", "rejected")
    aside = dict(zip(made, fresh(docs, *made)))
    found = classify(docs.withColumnsRenamed(aside), model, text).where("not rejected").drop(*made)
    return found.withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)
