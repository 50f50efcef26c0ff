"""Why a query failed, and tables derived from reference runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_answer


def classify_qa(rows: DataFrame, gt: DataFrame) -> DataFrame:
    """One verdict a query: NO_SUBMISSION, GT_UNUSABLE, OK, ANSWER_MISS, NEAR_MISS, NO_VIDEO."""
    told = gt.select("query_id", "video_id", "lo", "hi", F.transform("answers", normalize_answer).alias("ok"))
    joined = rows.join(told, ["query_id", "video_id"], "left")
    moment = F.coalesce(F.col("frame_idx").between(F.col("lo"), F.col("hi")), F.lit(False))
    right = moment & F.coalesce(F.array_contains("ok", normalize_answer(F.col("answer"))), F.lit(False))
    own = joined.groupBy("query_id").agg(F.bool_or(F.col("lo").isNotNull()).alias("video"), F.bool_or(moment).alias("moment"), F.bool_or(right).alias("right"))
    usable = gt.groupBy("query_id").agg(F.bool_or(F.col("lo").isNotNull()).alias("usable"))
    verdict = F.when(~F.col("usable"), "GT_UNUSABLE").when(F.col("video").isNull(), "NO_SUBMISSION").when(F.col("right"), "OK").when(F.col("moment"), "ANSWER_MISS").when(F.col("video"), "NEAR_MISS").otherwise("NO_VIDEO")
    return usable.join(own, "query_id", "left").withColumn("verdict", verdict)


def first_ranks(rows: DataFrame, gt: DataFrame, limit: int = 100) -> DataFrame:
    """First rank on a right video, first hit, and the distance between them."""
    joined = rows.join(gt.select("query_id", "video_id", "lo", "hi"), ["query_id", "video_id"])
    out = joined.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.min(F.when(F.col("frame_idx").between(F.col("lo"), F.col("hi")), F.col("rank"))).alias("first_hit"))
    return out.withColumn("headroom", F.coalesce(F.col("first_hit") - F.col("first_rank"), F.lit(limit)))


def ground_truth_from(rows: DataFrame, margin: int, head: int = 5) -> DataFrame:
    """Windows around the head rows of the first row's video."""
    first = rows.where("rank = 1").select("query_id", F.col("video_id").alias("v"))
    near = rows.where(F.col("rank") <= head).join(first, "query_id").where("video_id = v")
    return near.select("query_id", F.col("rank").alias("event_idx"), "video_id", (F.col("frame_idx") - margin).alias("lo"), (F.col("frame_idx") + margin).alias("hi"), "answer")


def nearest_rank(rows: DataFrame, group: str, value: str, shares=((50, 0.5), (95, 0.95), (99, 0.99))) -> DataFrame:
    """Nearest-rank percentiles by position (half to even), without gathering a group."""
    own = Window.partitionBy(group)
    told = rows.select(group, value, (F.row_number().over(own.orderBy(value)) - 1).alias("p"), F.count("*").over(own).alias("n"))
    return told.groupBy(group).agg(*[F.max(F.when(F.col("p") == F.bround(F.lit(q) * (F.col("n") - 1)), F.col(value))).alias(f"p{name}") for name, q in shares])
