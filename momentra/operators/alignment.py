"""Rebuilding keyframe maps from hashes: global monotone match, then a local search around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import match_monotonic


def rebuild_map(keys: DataFrame, stream: DataFrame, n_keys: int, around: int = 2, stride: int = 4) -> DataFrame:
    """``video_id, hash_no, frame_idx``: frames of ``stream (video_id, frame_idx, h)`` for ``keys (video_id, hash_no, h)``.

    Every ``stride``-th stream frame is matched first; then each key takes the closest frame within
    ``around`` of its match. Frames grow strictly: a later key never falls on or before an earlier one.
    """
    def distance(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))

    coarse = stream.where(F.col("frame_idx") % stride == 0)
    costs = keys.select("video_id", "hash_no", F.col("h").alias("hk")).join(coarse, "video_id").select("video_id", "hash_no", F.col("frame_idx").alias("position"), distance("hk", "h").alias("cost"))
    found = match_monotonic(costs, n_keys).select("video_id", F.posexplode("positions").alias("hash_no", "at"))
    near = found.select("video_id", "hash_no", F.explode(F.sequence(F.col("at") - around, F.col("at") + around)).alias("frame_idx"))
    near = near.join(stream, ["video_id", "frame_idx"]).join(keys.select("video_id", "hash_no", F.col("h").alias("hk")), ["video_id", "hash_no"])
    best = near.groupBy("video_id", "hash_no").agg(F.min(F.struct(distance("hk", "h").alias("d"), "frame_idx")).alias("b")).select("video_id", "hash_no", F.col("b.frame_idx").alias("frame_idx"))
    # strictly increasing: running maximum of frame - number, plus number
    run = Window.partitionBy("video_id").orderBy("hash_no").rowsBetween(Window.unboundedPreceding, 0)
    return best.withColumn("frame_idx", F.max(F.col("frame_idx") - F.col("hash_no")).over(run) + F.col("hash_no"))
