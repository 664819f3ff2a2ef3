"""Lexical search: matching on the vocabulary, then one join with the postings.

A query token matches a node's tokens exactly (weight idf), else as a prefix in either
direction (0.7), else by trigrams (0.4). Where several tokens of the lower tiers match,
the heaviest counts, so the answer does not depend on any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text
from ..functions.tables import cut, written

# Words that tell what a question is about, and kinds whose dotted labels are names of code.
TEST_WORDS = {"test", "tests", "testing", "spec"}
IMPORT_WORDS = {"import", "imports", "imported", "module"}
CALLABLE = ("function", "method", "class", "interface", "file", "module", "table", "document", "section", "topic")


def query_tokens(question: str) -> list[str]:
    apart = re.sub("(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", question)
    return [t for t in re.findall("[a-z0-9]+", apart.lower()) if len(t) > 1]


def postings(nodes: DataFrame) -> DataFrame:
    """``id``, ``token``: each distinct token of label and source. Write it once per snapshot to search it often."""
    words = F.array_distinct(text.tokens(F.concat_ws(" ", "label", "source")))
    return nodes.select("id", F.explode(words).alias("token"))


def may_match(token, asked: list[str]):
    """Whether a token can match one of a question's in any tier: it is one or begins one, or shares a trigram."""
    grams = sorted({t[i : i + 3] for t in asked for i in range(len(t) - 2)})
    starts = sorted({t[:i] for t in asked for i in range(1, len(t) + 1)})
    near = token.isin(*starts)
    return near | token.rlike("|".join(grams)) if grams else near


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def scores(nodes: DataFrame, questions: DataFrame, post: DataFrame | None = None) -> DataFrame:
    """``qid``, ``id``, raw ``score`` of every matching node, for one or many ``questions(qid, pos, token)``.

    Each tier is an equi-join of the vocabulary with the questions' tokens: by the token,
    by its leading parts, by trigrams.
    """
    post = post if post is not None else postings(nodes)
    n = nodes.agg(F.count("*").alias("n"))
    vocabulary = document_frequency(post).crossJoin(n).select("token", text.idf("df", F.col("n")).alias("idf"))  # one row
    asked = questions.select(F.col("token").alias("qt")).distinct()
    starts = lambda c, least: F.transform(F.sequence(F.lit(least), F.length(c)), lambda i: F.substr(c, F.lit(1), i))
    long = lambda df, c: df.where(F.length(c) >= L.TRIGRAM_LENGTH).select(c, F.size(text.trigrams(c)).alias(f"n_{c}"), F.explode(text.trigrams(c)).alias("gram"))
    words = vocabulary.select("token")
    exact = words.join(asked, F.col("token") == F.col("qt")).select("token", "qt", F.lit(1).alias("tier"))
    # A token that starts with the question's, and one that the question's starts with.
    able = asked.where(F.length("qt") >= L.PREFIX_LENGTH)
    parts = words.where(F.length("token") >= L.PREFIX_LENGTH).select("token", F.explode(starts(F.col("token"), L.PREFIX_LENGTH)).alias("qt"))
    longer = parts.join(able, "qt").select("token", "qt", F.lit(2).alias("tier"))
    shorter = able.select("qt", F.explode(starts(F.col("qt"), 1)).alias("token")).join(words, "token").select("token", "qt", F.lit(2).alias("tier"))
    shared = long(words, "token").join(long(asked, "qt"), "gram").groupBy("token", "n_token", "qt", "n_qt").agg(F.count("*").alias("same"))
    near = shared.where(2.0 * F.col("same") / (F.col("n_token") + F.col("n_qt")) >= L.TRIGRAM_DICE).select("token", "qt", F.lit(3).alias("tier"))
    tiers = exact.unionByName(longer).unionByName(shorter).unionByName(near).groupBy("token", "qt").agg(F.min("tier").alias("tier"))
    share = F.when(F.col("tier") == 1, L.EXACT).when(F.col("tier") == 2, L.PREFIX).otherwise(L.TRIGRAM)
    match = tiers.join(questions.withColumnRenamed("token", "qt"), "qt").join(vocabulary, "token")
    match = match.select("qid", "pos", "token", "tier", (share * F.col("idf")).alias("w"))
    best = post.join(match, "token").groupBy("qid", "id", "pos").agg(F.min(F.struct("tier", (-F.col("w")).alias("w"))).alias("m"))
    # Summed in the order of the question's tokens, so that floats add up alike in every run.
    parts = F.sort_array(F.collect_list(F.struct("pos", (-F.col("m.w")).alias("w"))))
    folded = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["w"])
    return best.groupBy("qid", "id").agg(folded.alias("score"))


def search(nodes: DataFrame, edges: DataFrame, question: str, budget: int = L.BUDGET, post: DataFrame | None = None) -> DataFrame:
    """Hits of one question within an output budget: ``rank``, ``id`` .. ``score``, ``neighbors``.

    Order: score, then id. Import stubs count a quarter unless the question is about
    imports; test sources a half unless it is about tests; dotted labels of things that
    aren't code a fifth. The first hit always stays, further ones while the running cost
    (bytes of what is shown, by four) is in the budget, at most 20; each has at most
    12 neighbours in the order of edges.
    """
    asked = query_tokens(question)
    shape = "qid int, pos int, token string"
    questions = nodes.sparkSession.createDataFrame([(0, i, t) for i, t in enumerate(asked)], shape)
    weight = F.when(F.contains("label", F.lit(".")) & ~F.col("kind").isin(*CALLABLE), L.DOTTED_WEIGHT).otherwise(1.0)
    if not IMPORT_WORDS & set(asked):
        weight = weight * F.when(text.is_stub("id"), L.STUB_WEIGHT).otherwise(1.0)
    if not TEST_WORDS & set(asked):
        weight = weight * F.when(text.is_test_path("source"), L.TEST_WEIGHT).otherwise(1.0)
    best = lambda df: df.where("score > 0").orderBy(F.desc(F.round("score", 9)), "id").limit(L.MAX_HITS)
    if post is None:
        # Texts are taken apart once; only tokens that may match are kept, with their node's weight.
        words = F.array_distinct(F.filter(text.tokens(F.concat_ws(" ", "label", "source")), lambda t: may_match(t, asked)))
        post = written(nodes.select("id", weight.alias("weight"), F.explode(words).alias("token")), "postings")
        # An id is one node's, so the first hits are those of the first ids.
        by_id = scores(nodes, questions, post.select("id", "token")).join(post.groupBy("id").agg(F.max("weight").alias("weight")), "id")
        by_id = by_id.withColumns({"raw": F.col("score"), "score": F.col("score") * F.col("weight")})
        hit = nodes.join(F.broadcast(cut(best(by_id).select("qid", "id", F.col("raw").alias("score")))), "id")
    else:
        hit = nodes.join(scores(nodes, questions, post), "id")
    top = cut(best(hit.withColumn("score", F.col("score") * weight)))
    return within_budget(with_neighbors(top, edges), budget)


def with_neighbors(hits: DataFrame, edges: DataFrame, cap: int = L.MAX_NEIGHBORS) -> DataFrame:
    """``hits`` (bounded) plus ``neighbors``: array<struct<id, relation, dir>> of both directions."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "relation", F.lit("out").alias("dir"), "source", "target")
    into = edges.where("source <> target").select(F.col("target").alias("id"), F.col("source").alias("other"), "relation", F.lit("in").alias("dir"), "source", "target")
    wanted = F.broadcast(hits.select("id"))
    near = out.unionByName(into).join(wanted, "id")
    place = F.row_number().over(Window.partitionBy("id").orderBy("source", "target", "relation", F.desc("dir")))
    near = near.withColumn("n", place).where(F.col("n") <= cap)
    listed = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "other", "relation", "dir"))).alias("l"))
    named = F.transform("l", lambda x: F.struct(x["other"].alias("id"), x["relation"].alias("relation"), x["dir"].alias("dir")))
    none = F.array().cast("array<struct<id:string,relation:string,dir:string>>")
    return hits.join(listed.select("id", named.alias("neighbors")), "id", "left").withColumn("neighbors", F.coalesce("neighbors", none))


def cost():
    """Tokens that a hit takes: its bytes and those of its neighbours, by four."""
    own = F.octet_length("id") + F.octet_length("label") + F.octet_length("source") + F.octet_length("location")
    own = own + F.octet_length(F.coalesce(F.try_element_at("metadata", F.lit("signature")), F.lit(""))) + 16
    near = F.aggregate("neighbors", F.lit(0), lambda a, x: a + F.octet_length(x["id"]) + F.octet_length(x["relation"]) + 8)
    return F.floor((own + near) / 4).cast("long")


def within_budget(hits: DataFrame, budget: int) -> DataFrame:
    """At most 20 rows come in, so one window over all of them is small."""
    order = Window.orderBy(F.desc(F.round("score", 9)), "id")
    ranked = hits.withColumn("cost", cost()).withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("spent", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where((F.col("rank") == 1) | (F.col("spent") <= budget)).where(F.col("rank") <= L.MAX_HITS)
    return kept.withColumn("score", text.round2("score")).drop("spent")


def federated(nodes: DataFrame, edges: DataFrame, question: str, modules: list[str] | None = None, budget: int = L.BUDGET) -> DataFrame:
    """Search in some modules (column ``module``); if they have no hit, in all."""
    if modules:
        found = search(nodes.where(F.col("module").isin(*modules)), edges, question, budget)
        if found.limit(1).count():
            return found
    return search(nodes, edges, question, budget)
