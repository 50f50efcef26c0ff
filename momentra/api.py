"""The engine as plain functions over one data folder: what a service would expose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import dot
from .operators import fusion, greedy, sequence
from .params import FusionParams, TemporalParams
from .sources.tables import Tables


class Engine:
    """Searches run as one plan each; vectors come in from any provider."""

    def __init__(self, spark: SparkSession, folder: str, params: FusionParams = FusionParams(), temporal: TemporalParams = TemporalParams()):
        self.tables, self.params, self.temporal = Tables(spark, folder), params, temporal

    def health(self) -> dict:
        c = self.tables.catalog.agg(F.count("*").alias("frames"), F.countDistinct("video_id").alias("videos")).first()
        return c.asDict()

    def search(self, vectors: DataFrame, k: int | None = None) -> DataFrame:
        """Ranked keyframes for ``vectors (query_id, qv)``, of any number."""
        t = self.tables
        s = t.vectors.join(vectors).select("query_id", "global_id", dot(F.col("qv"), F.col("v")).alias("score"))
        top = t.with_video(fusion.top_k(s, self.params.topk, ["query_id"]).drop("rank"))
        boosted = fusion.neighbor_boost(top, self.params.neighbor_boost, self.params.neighbor_window)
        return fusion.top_k(boosted, k or self.params.display_k, ["query_id"])

    def nearest(self, global_id: int, k: int = 12) -> DataFrame:
        v = self.tables.vectors.where(F.col("global_id") == global_id).select(F.lit(0).alias("query_id"), F.col("v").alias("qv"))
        return fusion.top_k(self.search(v, k + 1).drop("rank").where(F.col("global_id") != global_id), k, ["query_id"])

    def avs(self, vectors: DataFrame, limit: int = 100) -> DataFrame:
        rows = self.search(vectors, 500).drop("video_id").join(self.tables.catalog.select("global_id", "video_id", "pts_time"), "global_id")
        return greedy.diversify(rows, limit=limit)

    def trake(self, events: DataFrame, n_events: int) -> DataFrame:
        """Chains for ``events (query_id, event_idx, qv)``: videos pooled by event hits, then aligned."""
        t, p = self.tables, self.temporal
        sims = t.vectors.join(events).select("query_id", "event_idx", "global_id", dot(F.col("qv"), F.col("v")).alias("sim"))
        sims = sims.join(t.catalog.select("global_id", "video_id", "n", F.col("pts_time").alias("time")), "global_id")
        pooled = sequence.pool_videos(sims.withColumnRenamed("sim", "score"), p.videos).select("query_id", "video_id")
        best = sequence.align(sims.join(pooled, ["query_id", "video_id"]), n_events, p.max_gap, p.min_gap, p.floor, p.penalty)
        return best.withColumn("global_id", F.col("last")).withColumn("rank", F.row_number().over(fusion.Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id", "last"))).where(F.col("rank") <= p.topk).drop("global_id")
