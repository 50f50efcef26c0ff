"""Exact offline scoring: hits, R@k, coverage, run reports, comparisons, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_answer
from ..params import KS


def hits(rows: DataFrame, gt: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: the frame lies in a window of its video (bounds included)."""
    windows = gt.where("lo is not null").select("query_id", "video_id", "lo", "hi")
    joined = rows.join(windows, ["query_id", "video_id"], "left").withColumn("in", F.coalesce(F.col("frame_idx").between(F.col("lo"), F.col("hi")), F.lit(False)))
    return joined.groupBy(*rows.columns).agg(F.bool_or("in").alias("hit"))


def qa_hits(rows: DataFrame, gt: DataFrame) -> DataFrame:
    """``hit`` where the moment is right and the normalised answer is one of the accepted ones."""
    windows = gt.where("lo is not null").select("query_id", "video_id", "lo", "hi", F.transform("answers", normalize_answer).alias("accepted"))
    joined = rows.join(windows, ["query_id", "video_id"], "left")
    ok = F.col("frame_idx").between(F.col("lo"), F.col("hi")) & F.array_contains("accepted", normalize_answer(F.col("answer")))
    return joined.withColumn("in", F.coalesce(ok, F.lit(False))).groupBy(*rows.columns).agg(F.bool_or("in").alias("hit"))


def trake_scores(rows: DataFrame, gt: DataFrame) -> DataFrame:
    """``query_id, rank, r``: share of a query's ordered events that the row's frames hit.

    Unreadable events (null windows) stay in the denominator.
    """
    each = rows.select("query_id", "rank", "video_id", F.posexplode("frames").alias("event_idx", "frame"))
    joined = gt.select("query_id", "event_idx", F.col("video_id").alias("gv"), "lo", "hi").join(each, ["query_id", "event_idx"])
    ok = (F.col("gv") == F.col("video_id")) & F.coalesce(F.col("frame").between(F.col("lo"), F.col("hi")), F.lit(False))
    n = gt.groupBy("query_id").agg(F.count("*").alias("n"))
    return joined.groupBy("query_id", "rank").agg(F.count_if(ok).alias("k")).join(n, "query_id").select("query_id", "rank", (F.col("k") / F.col("n")).alias("r"))


def r_at_k(scored: DataFrame, ks=KS) -> DataFrame:
    """``query_id, r_1 .. r_100, final`` from ``query_id, rank, r``: best of the first k rows, and the mean."""
    out = scored.where("rank <= 100").groupBy("query_id").agg(*[F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0.0)).alias(f"r_{k}") for k in ks])
    total = sum((F.col(f"r_{k}") for k in ks[1:]), F.col(f"r_{ks[0]}"))
    return out.withColumn("final", total / len(ks))


def qualifier(first_hit: Column) -> Column:
    """Score by the rank of the first hit; 0 without one."""
    return F.when(first_hit == 1, 1.0).when(first_hit <= 5, 0.8).when(first_hit <= 20, 0.6).when(first_hit <= 50, 0.4).when(first_hit <= 100, 0.2).otherwise(0.0)


def report(scores: DataFrame, entries: DataFrame) -> DataFrame:
    """Mean final by task and over all: ``entries (query_id, task)`` are the denominators, missing ones count 0."""
    joined = entries.join(scores.select("query_id", "final"), "query_id", "left")
    sets = joined.cube("task").agg(F.count("*").alias("n"), F.count("final").alias("scored"), F.sum(F.coalesce("final", F.lit(0.0))).alias("sum_final"))
    return sets.select(F.coalesce("task", F.lit("all")).alias("task"), "n", "scored", "sum_final", (F.col("sum_final") / F.col("n")).alias("mean_final"))


def coverage(rows: DataFrame, targets: DataFrame, ks=KS) -> DataFrame:
    """Share of distinct targets that are hit within the first k rows."""
    joined = targets.join(rows.select("query_id", "video_id", "frame_idx", "rank"), ["query_id", "video_id"], "left")
    ok = F.col("frame_idx").between(F.col("lo"), F.col("hi"))
    first = joined.groupBy("query_id", "event_idx").agg(F.min(F.when(ok, F.col("rank"))).alias("first"))
    return first.groupBy("query_id").agg(*[F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias(f"c_{k}") for k in ks])


def top1_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``query_id, status`` of two runs' first rows: only a, only b, same, changed."""
    x = a.where("rank = 1").select("query_id", F.struct("video_id", "frame_idx").alias("a"))
    y = b.where("rank = 1").select("query_id", F.struct("video_id", "frame_idx").alias("b"))
    status = F.when(F.col("b").isNull(), "only a").when(F.col("a").isNull(), "only b").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return x.join(y, "query_id", "full").select("query_id", status.alias("status"))


def diff_counts(a: DataFrame, b: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Counts of queries improved, worsened, unchanged, new and gone from ``a`` to ``b``."""
    x, y = a.select("query_id", F.col("final").alias("x")), b.select("query_id", F.col("final").alias("y"))
    j = x.join(y, "query_id", "full")
    d = F.col("y") - F.col("x")
    return j.agg(F.count_if(d > eps).alias("improved"), F.count_if(d < -eps).alias("worsened"), F.count_if(F.abs(d) <= eps).alias("unchanged"), F.count_if(F.col("x").isNull()).alias("new"), F.count_if(F.col("y").isNull()).alias("gone"))


def confidence_margin(rows: DataFrame) -> DataFrame:
    """``query_id, margin``: (best - middle) / |best| clipped to [0, 1]; 0 below ten rows.

    The middle score is read by position (score descending), so no list is gathered.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    told = rows.select("query_id", "score", F.row_number().over(w).alias("p"), F.count("*").over(Window.partitionBy("query_id")).alias("n"))
    own = told.groupBy("query_id").agg(F.max("n").alias("n"), F.max(F.when(F.col("p") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("p") == F.floor(F.col("n") / 2) + 1, F.col("score"))).alias("mid"))
    m = (F.col("top") - F.col("mid")) / (F.abs("top") + 1e-12)
    return own.select("query_id", F.when(F.col("n") < 10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), m))).alias("margin"))


def video_share(rows: DataFrame, head: int = 10) -> DataFrame:
    """Share of the head's rows on the first row's video."""
    first = rows.where("rank = 1").select("query_id", F.col("video_id").alias("v1"))
    return rows.where(F.col("rank") <= head).join(first, "query_id").groupBy("query_id").agg(F.avg((F.col("video_id") == F.col("v1")).cast("double")).alias("share"))


def consensus(rows: DataFrame, refused: Column, head: int = 30) -> DataFrame:
    """Majority share of real answers in the head; refused answers stay in the denominator."""
    key = normalize_answer(F.col("answer"))
    counts = rows.where(F.col("rank") <= head).select("query_id", key.alias("k"), refused.alias("no")).groupBy("query_id", "k", "no").agg(F.count("*").alias("c"))
    return counts.groupBy("query_id").agg((F.coalesce(F.max(F.when(~F.col("no"), F.col("c"))), F.lit(0)) / F.sum("c")).alias("agree"))


def combined_confidence(parts: DataFrame, weights=(("margin", 0.5), ("share", 0.3), ("agree", 0.2))) -> DataFrame:
    """Weighted mean of the components that are there, rounded to 6 places."""
    top = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in weights), F.lit(0.0))
    low = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in weights), F.lit(0.0))
    return parts.withColumn("confidence", F.round(F.coalesce(F.try_divide(top, low), F.lit(0.0)), 6))


def select_weak(confidence: DataFrame, below: float, share: float) -> DataFrame:
    """The least confident queries under a threshold, at most a share of all (rounded up)."""
    w = Window.partitionBy().orderBy("confidence", "query_id")  # one row a query
    told = confidence.select("query_id", "confidence", F.row_number().over(w).alias("p"), F.count("*").over(Window.partitionBy()).alias("n"))
    return told.where((F.col("confidence") < below) & (F.col("p") <= F.ceil(F.lit(share) * F.col("n")))).select("query_id", "confidence")
