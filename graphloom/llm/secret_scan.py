"""Secret scans with a trigram inverted index; DataFrame functions only.

Each rule's regular expression is parsed, and a Boolean query over trigrams that any
match must contain is derived from it: alternatives (OR) of trigram sets (AND). The
index has a posting (trigram, key) for every trigram of the queries that occurs in a
text; keys are digests of (id, text), so that a group of copies stays spread. Postings
are matched with the queries' clauses and intersected by counting: a key is a
candidate of a rule if it has all trigrams of one alternative. Candidates are verified
with the regular expression on the whole text. Rules without a mandatory trigram scan
every text. Index and texts meet in one join on the key, for which only texts whose key
may be a candidate's are shuffled.

Positions come from splitting: the pieces between matches and the matches themselves,
in turn, add up to the text, so running sums of their lengths are the spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, parted, prefix_sums


@dataclass(frozen=True)
class Rule:
    """``pattern`` holds for Java, Python and RE2 alike; matches of ``group`` under ``least`` characters are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Names and formats of secrets. The first three are the base kinds, in their order.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
RULES = (
    Rule("assign", "(" + "|".join(map(_either_case, _NAMES)) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
#: Largest number of exact strings, and of alternatives, kept while a query is derived; beyond it the query gets weaker, never wrong.
MAX_EXACT = 32


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _all_of(a: set | None, b: set | None) -> set | None:
    """AND of two queries in alternatives of trigram sets; None is 'any text'."""
    if a is None or b is None:
        return b if a is None else a
    both = {x | y for x in a for y in b}
    return both if len(both) <= MAX_EXACT else min(a, b, key=len)


def _of_exact(exact: set[str]) -> set | None:
    return None if any(len(x) < 3 for x in exact) else {_grams(x) for x in exact}


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigram sets, one of which any match's text holds; None if nothing is mandatory."""

    def sequence(items) -> tuple[set[str] | None, set | None]:
        """Exact strings of a whole sequence (None: not finite) and its query."""
        exact: set[str] | None = {""}
        query, whole = None, True
        for op, arg in items:
            part, need = one(str(op), arg)
            joined = {x + y for x in exact for y in part} if part is not None else None
            if joined is not None and len(joined) <= MAX_EXACT:
                exact = joined
            else:
                query, whole = _all_of(query, _of_exact(exact)), False
                exact = part if part is not None and len(part) <= MAX_EXACT else {""}
            query = _all_of(query, need)
        return (exact, query) if whole else (None, _all_of(query, _of_exact(exact)))

    def one(op: str, arg) -> tuple[set[str] | None, set | None]:
        if op == "LITERAL":
            return {chr(arg).lower()}, None
        if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            return {chr(a).lower() for _, a in arg}, None
        if op == "SUBPATTERN":
            return sequence(arg[-1])
        if op == "BRANCH":
            parts = [sequence(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                return set().union(*(e for e, _ in parts)), None
            needs = [q if e is None else _of_exact(e) for e, q in parts]
            return None, None if None in needs else set().union(*needs)
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = arg
            exact, need = sequence(body)
            if (least, most) == (0, 1) and exact is not None:
                return exact | {""}, None
            if least and exact is None:
                return None, need
            return None, _of_exact(exact) if least and exact else None
        return None, None

    exact, query = sequence(_parser.parse(pattern))
    found = _all_of(query, _of_exact(exact) if exact is not None else None)
    if not found:
        return None
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def index(docs: DataFrame, grams: list[str], text: str) -> DataFrame:
    """Postings (``gram``, ``key``) of the given trigrams in the lower-cased texts of ``docs(key, text)``."""
    lower = docs.select("key", F.lower(text).alias("lower"))
    present = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(g)), F.lit(g)) for g in grams]))
    return lower.select("key", F.explode(present).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """``key``, ``rules`` (names of the rules whose query the text holds) of ``docs(key, text)``."""
    spark = docs.sparkSession
    clauses = [(r.name, n, g, len(c)) for r in rules for n, c in enumerate(trigram_query(r.pattern) or []) for g in sorted(c)]
    shape = "rule string, clause int, gram string, needed int"
    wanted = spark.createDataFrame(clauses, shape)
    postings = index(docs, sorted({c[2] for c in clauses}), text).distinct()
    # The clauses are a fixed table of the rules: its size does not grow with the data.
    counted = postings.join(F.broadcast(wanted), "gram").groupBy("key", "rule", "clause", "needed").count()
    return counted.where(F.col("count") == F.col("needed")).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end>> of one rule's matches, in code points."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("long"))
    judged = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else matches
    gaps = F.slice(pieces, 1, F.size(matches))
    before = prefix_sums(F.zip_with(gaps, matches, lambda x, y: x + y))
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("size"), judged.alias("judged"), before.alias("at")), lambda x: x["judged"] >= rule.least)
    begin = lambda x: x["at"] + x["gap"]
    return F.transform(steps, lambda x: F.struct(begin(x).alias("start"), F.lit(rank).alias("rank"), (begin(x) + x["size"]).alias("end")))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    line = lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, then ``found``: array<struct<start, rank, end>>, rank being the rule's place in ``rules``.

    A null or empty text has no spans. Repeated rows stay; a null id is an id like
    others. A column of ``docs`` named ``found`` is replaced.
    """
    own_key, own_rules = fresh(docs, "key", "rules")
    key = F.sha2(F.concat_ws(":", F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256)
    whole = docs.withColumn(own_key, key)
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    hits = candidates(whole.select(F.col(own_key).alias("key"), F.col(text).alias("text")), indexed)
    hits = materialize(hits.select(F.col("key").alias(own_key), F.col("rules").alias(own_rules)), "secret-candidates")
    maybe, rest = parted(whole, hits.select(own_key), own_key)
    met = maybe.join(hits, own_key, "left").unionByName(rest.withColumn(own_rules, F.lit(None).cast("array<string>")))
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    parts = []
    for rank, rule in enumerate(rules):
        test = F.array_contains(own_rules, rule.name) if rule in indexed else F.col(text).rlike(rule.pattern)
        parts.append(F.when(test, _spans(body, rule, rank)).otherwise(none))
    return met.withColumn("found", reduce(lambda a, b: F.concat(a, b), parts)).drop(own_key, own_rules)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_<base kind>``, ``base_sha256``, ``spans`` per row of ``docs``; other columns are not read.

    A null or empty text has no spans: counts of 0, the digest of the empty string. Texts
    are searched whole. Repeated rows give repeated rows, a null doc_id stays null. An
    empty table gives an empty result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = scan(own, rules, "doc_id", "text")
    count = lambda n: F.size(F.filter("found", lambda s: s["rank"] == n)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE)],
        F.sha2(_joined(base, rules), 256).alias("base_sha256"),
        _joined(F.col("found"), rules).alias("spans"),
    )


def remove_leaks(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in which a rule finds a secret; all columns, also one named ``found``.

    Rows with a null or empty text stay, repeated rows stay or go together, and so do
    rows with equal texts whatever their ids. An empty table gives an empty result.
    """
    (aside,) = fresh(docs, "found")
    tagged = docs.withColumnRenamed("found", aside)
    kept = scan(tagged, rules, doc_id, text).where(F.size("found") == 0).drop("found")
    return kept.withColumnRenamed(aside, "found").select(*docs.columns)
