"""Byte-pair encoding by a dynamic program over prefixes, and decoding.

For every prefix of a word the encoding has exactly one last token. A token that
ends a prefix is that token if it starts the word or if it may follow the last
token of the prefix before it. Candidates come from an automaton over the
vocabulary that reports each token that is a suffix of the prefix (longest first);
whether two tokens may stand side by side is decided from the merge table alone
and remembered per pair. Back-pointers from the whole word give the ids.

The text is prepared as the vocabulary file says: special tokens are cut out of
the raw text, then NFC, lower case character by character, splitting, byte
letters. The file's bytes are sent to the executors once; their size is checked.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_values, without

#: The vocabulary file is broadcast; larger files are refused.
MAX_FILE_BYTES = 64 << 20
#: Words, in each of two generations, and token pairs whose result a worker remembers.
MAX_WORDS = 100_000
MAX_PAIRS = 300_000
#: Rows whose results are built at once.
ROWS = 512

# White space in Unicode, and the splitting patterns of the vocabulary.
_SPACE = "\t-\r \x85\xa0  -     　"
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ANY = regex.compile(rf"[\p{{L}}]+|'(?:[stmd]|re|ve|ll)|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
# The same for texts up to U+024F, with the letters and numbers there written out; the plain engine is faster.
_LETTERS, _NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
_BEYOND = re.compile("[^\x00-\u024f]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = itertools.count(256)
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class _Lower(dict):
    """Lower case of one character at a time (no context such as final sigma)."""

    def __missing__(self, code: int) -> str:
        self[code] = out = chr(code).lower()
        return out


class Encoder:
    """Encoder of one vocabulary file (``word_bpe`` kind: word ends, lower case)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, kinds = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        if (model["type"], kinds, spec["decoder"]) != ("BPE", ["NFC", "Replace", "Lowercase"], None) or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _SPLIT:
            raise ValueError("not a vocabulary of this kind")
        self.end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = _byte_letters()
        self.lower = _Lower()
        base = [x + e for e in ("", self.end) for x in self.letters]
        #: Per token: the rank of the merge that makes it (-1: none), its halves, and its text with " " as the word's end.
        self.rank, self.left, self.right = dict.fromkeys((vocab[x] for x in base), -1), {}, {}
        text = {vocab[x]: x.removesuffix(self.end) + " " * x.endswith(self.end) if len(x) > 1 else x for x in base}
        self.merge: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(model["merges"]):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merge[i, j] = self.rank[k] = n
            self.left[k], self.right[k] = i, j
            text[k] = text[i] + text[j]
        self.names = {i: x for x, i in vocab.items()} | {i: x for x, i in self.special.items()}
        self.automaton = ahocorasick.Automaton()
        for i, x in text.items():
            self.automaton.add_word(x, (i, len(x)))
        self.automaton.make_automaton()
        self.shown = {i: str(i) for i in self.names}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def forget(self) -> None:
        for known in (self.words, self.older, self.pairs):
            known.clear()

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before both are complete; undoes merges, latest first."""
        rank, merge, limit = self.rank, self.merge, len(self.merge)
        while True:
            if merge.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                return True

    def word_ids(self, letters: str) -> list[int]:
        """Ids of one word, given as byte letters and a space for its end."""
        last = [-1] * (len(letters) + 1)
        start = last[:]
        pairs, done = self.pairs, -1
        for at, (token, size) in self.automaton.iter(letters):
            if at == done:
                continue
            before = at + 1 - size
            if before:
                prior = last[before]
                if prior < 0:
                    continue
                pair = prior << 32 | token
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= MAX_PAIRS:
                        pairs.clear()
                    ok = pairs[pair] = self._compatible(prior, token)
                if not ok:
                    continue
            last[at + 1], start[at + 1], done = token, before, at
        out, at = [], len(letters)
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word, remembered in two generations so that frequent words stay."""
        done = self.older.get(word)
        if done is None:
            letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
            done = tuple(self.word_ids(letters + " "))
        if len(word) <= 64:
            if len(self.words) >= MAX_WORDS:
                self.older.clear()
                self.older.update(self.words)
                self.words.clear()
            self.words[word] = done
        return done

    def _split(self, part: str) -> list[str]:
        if part.isascii():
            return _LATIN.findall(part.lower())
        part = unicodedata.normalize("NFC", part)
        part = part.translate(self.lower) if "\u03a3" in part else part.lower()
        return (_ANY if _BEYOND.search(part) else _LATIN).findall(part)

    def encode(self, text: str) -> list[int]:
        get, word = self.words.get, self._word
        out: list[int] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += itertools.chain.from_iterable([get(w) or word(w) for w in self._split(part)])
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the file names no decoder. Ids that it doesn't have are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join([self.names[i] for i in ids if i in self.names])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(raw: bytes) -> Encoder:
    """Built once per worker process and file."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """All columns of ``docs`` but ``text``, then ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``.

    A null text counts as empty: no token, digests of the empty string. Row by row,
    so repeated rows and ids stay; result columns replace columns of ``docs`` with
    the same names, in whatever case. Words of any length are encoded whole. The decoded
    digest is of ``decode`` applied to the ids. An empty table gives an empty result.
    """
    raw = Path(path).read_bytes()
    if len(raw) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: over {MAX_FILE_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    made += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    keep = without(docs, text, *(f.name for f in made))
    schema = T.StructType([docs.schema[c] for c in keep] + made)

    def encoded(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sums, decoded, flat = [], [], [], [np.empty(0, np.int32)]
        for x in byte_values(batch, text):
            found = encoder.encode((x or b"").decode("utf-8", "replace"))
            counts.append(len(found))
            sums.append(hashlib.sha256(" ".join(map(encoder.shown.__getitem__, found)).encode()).hexdigest())
            decoded.append(hashlib.sha256(encoder.decode(found).encode()).hexdigest())
            if ids:
                flat.append(np.array(found, np.int32))
        arrays = [pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
        if ids:
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat))))
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *arrays], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                yield encoded(encoder, batch.slice(begin, ROWS))
        # The next task's texts, or another operator, get the memory.
        encoder.forget()
        pa.default_memory_pool().release_unused()

    return docs.select(*keep, text).mapInArrow(run, schema)
