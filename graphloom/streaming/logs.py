"""Append logs as streams, and producers that restate their rows per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import limits as L
from ..functions.schema import Batch
from ..sources.store import Store

USAGE = "ts timestamp, verb string, arg string, hits int, bytes bigint, ms bigint"
FEEDBACK = "question string, answer string, type string, nodes array<string>, outcome string, correction string, `when` timestamp"
AUDIT = "action string, actor string, after_hash string, before_hash string, target string, ts timestamp"


# Outcomes that feedback may have.
OUTCOMES = ("useful", "dead_end", "corrected")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_feedback(results: DataFrame, path: str) -> None:
    """Appends all rows or none: a question, nodes and a known outcome are required, and a correction if corrected."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    fault = F.when(blank("question"), "question is required").when(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), "outcome is unknown")
    fault = fault.when((F.col("outcome") == "corrected") & blank("correction"), "correction is required")
    bad = results.select(fault.alias("f")).where("f is not null").first()
    if bad:
        raise ValueError(bad.f)
    append(results, path)


def read_log(spark: SparkSession, path: str, shape: str, strict: bool) -> DataFrame:
    """``strict``: a bad line fails the read (feedback); else it is skipped (usage, audit)."""
    return spark.read.schema(shape).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def stream_log(spark: SparkSession, path: str, shape: str) -> DataFrame:
    return spark.readStream.schema(shape).json(path)


def daily_usage(usage: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and bytes by day and verb; rows later than the watermark don't reopen a day."""
    w = usage.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "verb")
    return w.agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes")).select(F.to_date("w.start").alias("day"), "verb", "count", "bytes")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("count")).select(key, "w.start", "w.end", "count")


def restate(stream: DataFrame, store: Store, producer: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the producer's rows. Replaying a batch gives the same store."""

    def put(df: DataFrame, batch_id: int) -> None:
        if df.limit(1).count():
            store.replace(Batch(producer, *split(df)), force=True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_scores(feedback: DataFrame, half_life: float = L.HALF_LIFE_DAYS) -> DataFrame:
    """Decayed score per node, kept as (score, last time) between micro-batches: ``node``, ``score``, ``at``.

    Rows of a node are folded in the order of their times; a row older than the last one
    is decayed to it, so arrival order does not change the score.
    """
    sign = F.when(F.col("outcome") == "useful", 1.0).when(F.col("outcome").isin("dead_end", "corrected"), -1.0)
    each = feedback.select(F.explode("nodes").alias("node"), sign.alias("sign"), F.unix_seconds("when").alias("t")).where("sign is not null")
    day = 86400.0 * half_life

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        score, last = state.get if state.exists else (0.0, None)
        for pdf in parts:
            for t, s in sorted(zip(pdf.t.tolist(), pdf.sign.tolist())):
                if last is None or t >= last:
                    score = (score * 0.5 ** ((t - last) / day) if last is not None else 0.0) + s
                    last = t
                else:
                    score += s * 0.5 ** ((last - t) / day)
        state.update((score, last))
        yield pd.DataFrame({"node": [key[0]], "score": [score], "at": [last]})

    return each.groupBy("node").applyInPandasWithState(fold, "node string, score double, at long", "score double, last long", "update", "NoTimeout")
