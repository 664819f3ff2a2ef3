"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text


def cochanges(commits: DataFrame, files: DataFrame, live: DataFrame | None = None, newest: int = L.COMMITS, max_files: int = L.COMMIT_FILES, support: int = L.MIN_SUPPORT, top: int = L.MAX_PAIRS) -> DataFrame:
    """``a``, ``b`` (a < b), ``support``, ``ratio`` (of the commits of a, two decimals), most support first.

    ``commits(commit_id, seq, is_merge)`` with the highest ``seq`` newest;
    ``files(commit_id, path)``. Merges and commits of more than ``max_files`` files don't
    count, whatever files are live; then files that are gone or named like secrets are
    left out. A commit's pairs are therefore bounded by max_files squared.
    """
    recent = commits.where("not is_merge").orderBy(F.desc("seq"), F.desc("commit_id")).limit(newest).select("commit_id")
    touched = files.join(recent, "commit_id").select("commit_id", "path").distinct()
    sized = touched.withColumn("n", F.count("*").over(Window.partitionBy("commit_id"))).where(F.col("n") <= max_files)
    sized = sized.where(~text.is_secret_name("path"))
    if live is not None:
        sized = sized.join(live.select("path"), "path", "left_semi")
    single = sized.groupBy("path").agg(F.count("*").alias("changes"))
    pairs = sized.select("commit_id", F.col("path").alias("a")).join(sized.select("commit_id", F.col("path").alias("b")), "commit_id").where("a < b")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    rated = counted.join(single.withColumnRenamed("path", "a"), "a")
    rated = rated.withColumn("ratio", F.format_number(F.col("support") / F.col("changes"), 2))
    return rated.select("a", "b", "support", "ratio").orderBy(F.desc("support"), "a", "b").limit(top)


def cochange_edges(pairs: DataFrame) -> DataFrame:
    meta = F.create_map(F.lit("support"), F.col("support").cast("string"), F.lit("confidence_ratio"), F.col("ratio"))
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("co_changed_with").alias("relation"), F.lit("INFERRED").alias("confidence"), F.col("support").cast("double").alias("weight"), meta.alias("metadata"))
