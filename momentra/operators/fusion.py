"""Score-map algebra over ``(query_id, signal, global_id, score)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minmax(value: Column, over, degenerate: float | None, eps: float = 1e-9) -> Column:
    """Scales to [0, 1] inside a window; a flat window gives ``degenerate`` (None: the value itself)."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    flat = value if degenerate is None else F.lit(float(degenerate))
    return F.when(hi - lo < eps, flat).otherwise((value - lo) / (hi - lo))


def ranked(scores: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """Dense positions from 1: score descending, ties by the smaller id."""
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "global_id")))


def top_k(scores: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The ``k`` best rows of each group (the limit is pushed below the shuffle)."""
    return ranked(scores, by).where(F.col("rank") <= k)


def _weight(weights: dict[str, float]) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(pairs, F.col("signal")), F.lit(0.0))


def normalized(signals: DataFrame) -> DataFrame:
    return signals.withColumn("score", minmax(F.col("score"), Window.partitionBy("query_id", "signal"), 1.0))


def weighted_sum(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weighted min-max scores; zero-weight signals contribute neither scores nor ids."""
    used = signals.withColumn("w", _weight(weights)).where("w <> 0")
    used = normalized(used)
    return used.groupBy("query_id", "global_id").agg(F.sum(F.col("w") * F.col("score")).alias("score"))


def rrf(signals: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion with ranks from 1."""
    placed = ranked(signals, ["query_id", "signal"])
    w = _weight(weights) if weights else F.lit(1.0)
    return placed.groupBy("query_id", "global_id").agg(F.sum(w / (F.lit(k) + F.col("rank"))).alias("score"))


def aggregate_variants(signals: DataFrame, mean: bool = False) -> DataFrame:
    """Maximum over a query's variants, or the mean over those that hold the id."""
    how = F.avg("score") if mean else F.max("score")
    return signals.groupBy("query_id", "global_id").agg(how.alias("score"))


def _near(distance: int, value: Column) -> Column:
    """``value`` of the row exactly ``distance`` ids away in the same video (one shuffle, no join)."""
    return F.max(value).over(Window.partitionBy("query_id", "video_id").orderBy("global_id").rangeBetween(distance, distance))


def neighbor_boost(scores: DataFrame, boost: float = 0.10, window: int = 2) -> DataFrame:
    """Adds ``boost * s / d`` of candidates d ids away in the same video; reads the scores given."""
    extra = F.lit(0.0)
    for d in range(1, window + 1):
        for side in (-d, d):
            extra = extra + F.coalesce(F.greatest(_near(side, F.col("score")), F.lit(0.0)), F.lit(0.0)) * F.lit(boost / d)
    return scores.withColumn("boosted", F.col("score") + extra).withColumn("score", F.col("boosted")).drop("boosted")


def consistency_boost(scores: DataFrame, weight: float = 0.15, window: int = 2, decay: float = 0.5) -> DataFrame:
    """Raises candidates whose neighbours score too, relative to the query's best score."""
    if weight <= 0 or window <= 0:
        return scores
    top = F.max("score").over(Window.partitionBy("query_id"))
    support = F.lit(0.0)
    for d in range(1, window + 1):
        left, right = (F.coalesce(_near(s, F.col("score")), F.lit(0.0)) for s in (-d, d))
        support = support + F.when((left > 0) | (right > 0), F.lit(decay**d) * (left + right) / 2).otherwise(F.lit(0.0))
    scale = sum(decay**d for d in range(1, window + 1))
    told = scores.withColumn("top", top).withColumn("support", support / F.col("top"))
    lifted = F.col("score") + F.lit(weight) * F.col("top") * F.col("support") / F.lit(scale)
    return told.withColumn("score", F.when((F.col("top") > 0) & (F.col("support") > 0), lifted).otherwise(F.col("score"))).drop("top", "support")


def context_boost(scores: DataFrame, context: DataFrame, direction: str = "after", window: int = 12, weight: float = 0.25, head: int = 200) -> DataFrame:
    """Blends the best context similarity of one-sided neighbours into the head's scores.

    ``context (query_id, video_id, global_id, sim)`` covers the head's videos; both scores are
    min-maxed over the head, a flat one left as it is.
    """
    lo, hi = (1, window) if direction == "after" else (-window, -1)
    near = Window.partitionBy("query_id", "video_id").orderBy("global_id").rangeBetween(lo, hi)
    best = context.withColumn("near", F.max("sim").over(near)).select("query_id", "global_id", "near")
    placed = ranked(scores, ["query_id"]).join(best, ["query_id", "global_id"], "left").withColumn("in_head", F.col("rank") <= head)
    own = Window.partitionBy("query_id", "in_head")
    mixed = F.lit(1 - weight) * minmax(F.col("score"), own, None, 1e-12) + F.lit(weight) * minmax(F.coalesce("near", F.lit(0.0)), own, None, 1e-12)
    return placed.withColumn("score", F.when(F.col("in_head"), mixed).otherwise(F.col("score")))


def signal_map(signals: DataFrame) -> DataFrame:
    """One map of signal scores for each query and id."""
    return signals.groupBy("query_id", "global_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "score")))).alias("signals"))
