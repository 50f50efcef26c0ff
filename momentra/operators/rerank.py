"""Vector reranking of pools, feedback, cross and ballot scores, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize, mean_vector, norm
from .fusion import minmax, ranked, rrf


def _plus(a: str, b: str):
    return l2_normalize(F.zip_with(a, b, lambda x, y: x + F.coalesce(y, F.lit(0.0))))


def superglobal(pool: DataFrame, queries: DataFrame, dim: int, neighbors: int = 10, top: int = 10) -> DataFrame:
    """Refined scores of a pool ``(query_id, global_id, v)`` against ``queries (query_id, qv)``.

    Mean of two similarities: each vector moved towards its in-pool neighbours against the query, and
    each vector against the query moved towards its best rows. Zero vectors score 0. The pool is a
    bounded head of every query, so the self-join is bounded too.
    """
    unit = pool.withColumn("u", l2_normalize(F.col("v"))).withColumn("ok", norm(F.col("v")) > 1e-6)
    good = unit.where("ok").select("query_id", "global_id", "u")
    a = good.select("query_id", F.col("global_id"), F.col("u").alias("ua"))
    b = good.select("query_id", F.col("global_id").alias("other"), F.col("u").alias("ub"))
    near = a.join(b, "query_id").where("global_id <> other").withColumn("score", dot(F.col("ua"), F.col("ub")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "global_id").orderBy(F.desc("score"), "other"))).where(F.col("r") <= neighbors)
    around = near.groupBy("query_id", "global_id").agg(mean_vector("ub", dim).alias("m"))
    base = unit.join(queries, "query_id").withColumn("score", dot(F.col("u"), F.col("qv")))
    head = ranked(base.where("ok"), ["query_id"]).where(F.col("rank") <= top).groupBy("query_id").agg(mean_vector("u", dim).alias("hm"), F.first("qv").alias("q")).select("query_id", _plus("q", "hm").alias("q2"))
    told = base.join(around, ["query_id", "global_id"], "left").join(head, "query_id")
    s1 = F.when(F.col("m").isNull(), F.col("score")).otherwise(dot(_plus("u", "m"), F.col("qv")))
    return told.select("query_id", "global_id", F.when(F.col("ok"), (s1 + dot(F.col("u"), F.col("q2"))) / 2).otherwise(0.0).alias("score"))


def rocchio(queries: DataFrame, positive: DataFrame, negative: DataFrame, dim: int, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> DataFrame:
    """``query_id, qv``: the query moved towards the mean of wanted and away from unwanted vectors."""
    p = positive.groupBy("query_id").agg(mean_vector("v", dim).alias("p"))
    n = negative.groupBy("query_id").agg(mean_vector("v", dim).alias("n"))
    zero = F.array_repeat(F.lit(0.0), dim)
    told = queries.join(p, "query_id", "left").join(n, "query_id", "left").select("query_id", "qv", F.coalesce("p", zero).alias("p"), F.coalesce("n", zero).alias("n"))
    moved = F.zip_with(F.zip_with("qv", "p", lambda q, x: alpha * q + beta * x), "n", lambda q, x: q - gamma * x)
    return told.select("query_id", l2_normalize(moved).alias("qv"))


def cross_rerank(rows: DataFrame, cross: DataFrame, head: int = 100, weight: float = 0.5) -> DataFrame:
    """New ranks of the head by a blend of fused and cross scores; the tail and scores stay."""
    told = rows.join(cross, ["query_id", "global_id"], "left").withColumn("in_head", F.col("rank") <= head)
    own = Window.partitionBy("query_id", "in_head")
    blend = F.lit(1 - weight) * minmax(F.col("score"), own, 0.0, 1e-12) + F.lit(weight) * minmax(F.coalesce("cross", F.lit(0.0)), own, 0.0, 1e-12)
    told = told.withColumn("blend", F.round(blend, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("in_head"), F.when(F.col("in_head"), -F.col("blend")).otherwise(0.0), "rank")
    return told.withColumn("new_rank", F.row_number().over(w))


def ballot_rerank(rows: DataFrame, ballots: DataFrame, head: int = 24) -> DataFrame:
    """New ranks of the head by mean ballot score, ties by old rank."""
    mean = ballots.groupBy("query_id", "global_id").agg(F.avg("vote").alias("vote"))
    told = rows.join(mean, ["query_id", "global_id"], "left")
    inside = F.col("rank") <= head
    w = Window.partitionBy("query_id").orderBy(F.when(inside, 0).otherwise(1), F.when(inside, -F.coalesce("vote", F.lit(-1.0))).otherwise(0.0), "rank")
    return told.withColumn("new_rank", F.row_number().over(w))


def retry_low_confidence(primary: DataFrame, alternates: DataFrame, confidence: DataFrame, below: float = 0.25, k: int = 60) -> DataFrame:
    """Fuses primary and alternate rankings where the primary's confidence is low, keeping its length.

    Rankings are ``(query_id, signal, global_id, score)``; alternates have other signal names.
    """
    weak = confidence.where(F.col("margin") < below).select("query_id")
    both = rrf(primary.unionByName(alternates).join(weak, "query_id", "left_semi"), k)
    size = primary.groupBy("query_id").agg(F.count("*").alias("n"))
    fused = ranked(both.withColumn("score", F.round("score", 9)), ["query_id"]).join(size, "query_id").where("rank <= n").select("query_id", "rank", "global_id")
    rest = ranked(primary.join(weak, "query_id", "left_anti"), ["query_id"]).select("query_id", "rank", "global_id")
    return fused.unionByName(rest)


def pairwise_losses(pairs: DataFrame, scale: float = 10.0, bias: float = -5.0) -> DataFrame:
    """Sigmoid, contrastive and distillation losses of each batch of ``(batch, a, b, i, j)`` vector pairs.

    Pairs are summed where they are made; only a row each of ``i`` and ``j`` is moved.
    """
    s = pairs.select("batch", "i", "j", dot(F.col("a"), F.col("b")).alias("s"))
    logit = F.lit(scale) * F.col("s") + F.lit(bias)
    same = F.col("i") == F.col("j")
    e = F.exp(F.lit(scale) * F.col("s"))
    rows, cols = s.groupBy("batch", "i").agg(F.log(F.sum(e)).alias("lr")), s.groupBy("batch", "j").agg(F.log(F.sum(e)).alias("lc"))
    own = s.where(same).join(rows, ["batch", "i"]).join(cols, ["batch", "j"]).withColumn("c", (F.col("lr") + F.col("lc")) / 2 - F.lit(scale) * F.col("s"))
    told = own.groupBy("batch").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum(1 - F.col("s")).alias("d"))
    total = s.groupBy("batch").agg(F.sum(F.log1p(F.exp(F.when(same, -1.0).otherwise(1.0) * logit))).alias("g"))
    return total.join(told, "batch").select("batch", (F.col("g") / F.col("n")).alias("sigmoid"), (F.col("c") / F.col("n")).alias("contrastive"), (F.col("d") / F.col("n")).alias("distill"))
