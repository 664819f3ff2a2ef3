"""Usage, feedback, freshness, claims, sources: what logs and stamps say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text


def usage_by_verb(usage: DataFrame) -> DataFrame:
    """``verb``, ``count``, ``bytes``, ``avg_ms`` (whole)."""
    return usage.groupBy("verb").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"), F.floor(F.sum("ms") / F.count("*")).cast("long").alias("avg_ms"))


def usage_by_day(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("count"))


def usage_summary(usage: DataFrame, now: Column) -> DataFrame:
    """One row: totals, tokens, today, last 7 days, tokens saved and what they would have cost."""
    saved = F.when(F.col("verb") == "hook-context", 0).otherwise(F.greatest(F.lit(0), L.REPLACED_TOKENS - F.floor(F.col("bytes") / 4)))
    day = F.to_date("ts")
    out = usage.agg(
        F.count("*").alias("total"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_if(day == F.to_date(now)).alias("today"), F.count_if(day > F.date_sub(F.to_date(now), 7)).alias("last_7_days"),
        F.coalesce(F.sum(saved), F.lit(0)).cast("long").alias("saved_tokens"),
    )
    return out.withColumn("est_tokens", F.floor(F.col("bytes") / 4)).withColumn("saved_usd", F.col("saved_tokens") / 1e6 * L.USD_PER_MTOK)


def feedback_scores(results: DataFrame, now: Column, half_life: float = L.HALF_LIFE_DAYS) -> DataFrame:
    """Per node: ``score`` (useful +, dead end and corrected −, halved every half-life; the future counts as now), ``useful``."""
    age = (F.unix_micros(now) - F.unix_micros("when")) / (86400.0 * 1e6)
    sign = F.when(F.col("outcome") == "useful", 1.0).when(F.col("outcome").isin("dead_end", "corrected"), -1.0)
    each = results.select(F.explode("nodes").alias("node"), (sign * text.decay(age, half_life)).alias("s"), F.col("outcome"))
    each = each.where("s is not null")
    return each.groupBy("node").agg(F.sum("s").alias("score"), F.count_if(F.col("outcome") == "useful").alias("useful"))


def lessons(results: DataFrame, now: Column, half_life: float = L.HALF_LIFE_DAYS, corroboration: int = L.MIN_CORROBORATION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Preferred nodes, dead ends, corrections (of the results that were corrected)."""
    scored = feedback_scores(results, now, half_life)
    preferred = scored.where((F.col("score") > 0) & (F.col("useful") >= corroboration)).orderBy(F.desc("score"), "node")
    dead = scored.where(F.col("score") < 0).orderBy("score", "node")
    fixes = results.where("outcome = 'corrected'").select("when", "question", "correction").orderBy("when", "question")
    return preferred, dead, fixes


def judged(marks: DataFrame, floor: float) -> DataFrame:
    """``marks(question, mark)``, each from 0 to 1: one row ``total``, ``questions``, ``passed`` (not under the floor)."""
    return marks.agg(F.coalesce(F.sum("mark"), F.lit(0.0)).alias("total"), F.count("*").alias("questions")).withColumn("passed", F.col("total") >= floor)


STATES = ("fresh", "unknown", "stale")


def freshness(sources: DataFrame) -> DataFrame:
    """``sources(path, head, head_unix, current, current_unix)``: ``state`` and ``behind`` (seconds)."""
    known = (F.coalesce("head", F.lit("")) != "") & (F.coalesce("current", F.lit("")) != "")
    state = F.when(~known, "unknown").when(F.col("head") == F.col("current"), "fresh").otherwise("stale")
    behind = F.when(state == "stale", F.greatest(F.col("current_unix") - F.col("head_unix"), F.lit(0))).otherwise(0)
    return sources.withColumn("state", state).withColumn("behind", behind)


def overall(states: DataFrame) -> DataFrame:
    """Stale if any is, else unknown if any is (or there is none), else fresh: ``state``, ``exit_code`` (0, 1, 2)."""
    rank = F.when(F.col("state") == "stale", 2).when(F.col("state") == "unknown", 1).otherwise(0)
    worst = states.agg(F.coalesce(F.max(rank), F.lit(1)).alias("r"))
    code = F.when(F.col("r") == 2, 1).when(F.col("r") == 1, 2).otherwise(0)
    return worst.select(F.element_at(F.array(*map(F.lit, STATES)), F.col("r") + 1).alias("state"), code.alias("exit_code"))


def verify(claims: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``claims(claim)`` against ``nodes`` and ``files(path, lines, changed)``: ``claim``, ``verdict``, ``node``.

    ``path:L2-L9`` is checked against the file; anything else is a node's exact id, or a
    label whatever its case (the smallest id of several). Never by likeness.
    """
    cite = r"^(.+):L(\d+)(?:-L?(\d+))?$"
    c = claims.select("claim", F.regexp_extract("claim", cite, 1).alias("path"), F.nullif(F.regexp_extract("claim", cite, 2), F.lit("")).cast("int").alias("a"), F.nullif(F.regexp_extract("claim", cite, 3), F.lit("")).cast("int").alias("b"))
    c = c.withColumn("b", F.coalesce("b", "a"))
    by_id = nodes.select(F.col("id").alias("claim"), F.col("id").alias("node_id"), F.col("source").alias("id_source"), F.col("location").alias("id_loc"))
    by_label = nodes.groupBy(F.lower("label").alias("lower")).agg(F.min(F.struct("id", "source", "location")).alias("l"))
    met = c.join(by_id, "claim", "left").withColumn("lower", F.lower("claim")).join(by_label, "lower", "left")
    node = F.coalesce("node_id", "l.id")
    source = F.when(F.col("path") != "", F.col("path")).otherwise(F.coalesce("id_source", "l.source"))
    first, last = text.location_lines(F.coalesce("id_loc", "l.location", F.lit("")))
    met = met.withColumns({"node": F.when(F.col("path") == "", node), "file": source, "last": F.when(F.col("path") != "", F.col("b")).otherwise(last), "first": F.when(F.col("path") != "", F.col("a")).otherwise(first)})
    out = met.join(files.withColumnRenamed("path", "file"), "file", "left")
    uri = F.contains("file", F.lit("://"))
    verdict = (
        F.when((F.col("path") == "") & F.col("node").isNull(), "missing-node").when((F.col("path") == "") & uri, "ok")
        .when(F.col("lines").isNull(), "missing-file")
        .when((F.col("last") > F.col("lines")) | (F.col("first") < 1) | (F.col("first") > F.col("last")), "out-of-range")
        .when(F.col("changed"), "drifted").otherwise("ok")
    )
    return out.select("claim", verdict.alias("verdict"), "node")


def due(sources: DataFrame, now_unix: int, ttl: int = L.SOURCE_TTL_SECONDS, mode: str = "ttl") -> DataFrame:
    """``sources(id, captured_unix)`` to be captured now: all, none, or those never captured or older than the ttl."""
    if mode == "always":
        return sources
    if mode == "never":
        return sources.where("false")
    return sources.where(F.col("captured_unix").isNull() | (F.lit(now_unix) - F.col("captured_unix") >= ttl))
