"""Sequential per-group choices: near-duplicate runs, diversification, vote-driven promotion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def suppress_near_dups(frames: DataFrame, most: float = 0.97) -> DataFrame:
    """``global_id, kept``: frames of a video in order; one too similar to the last frame kept goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        kept, last = [], None
        for v in pdf["v"]:
            v = np.asarray(v, float)
            v = v / max(np.linalg.norm(v), 1e-12)
            keep = last is None or float(v @ last) <= most
            last = v if keep else last
            kept.append(keep)
        return pd.DataFrame({"global_id": pdf["global_id"], "kept": kept})

    return frames.groupBy("video_id").applyInPandas(run, "global_id long, kept boolean")


def _spread(pdf: pd.DataFrame, cap: int, gap: float) -> list[bool]:
    taken: dict = {}
    out = []
    for v, t in zip(pdf["video_id"], pdf["pts_time"], strict=True):
        times = taken.setdefault(v, [])
        ok = len(times) < cap and all(abs(t - x) >= gap for x in times)
        if ok:
            times.append(t)
        out.append(ok)
    return out


def diversify(rows: DataFrame, cap: int = 3, gap: float = 10.0, limit: int = 100) -> DataFrame:
    """Rank order with at most ``cap`` rows a video, ``gap`` seconds apart; skipped rows fill up the end.

    The greedy choice inside a video never depends on other videos, so groups are single videos.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        return pdf.assign(picked=_spread(pdf, cap, gap))[["query_id", "rank", "video_id", "global_id", "picked"]]

    picked = rows.select("query_id", "rank", "video_id", "global_id", "pts_time").groupBy("query_id", "video_id").applyInPandas(run, "query_id long, rank int, video_id string, global_id long, picked boolean")
    w = Window.partitionBy("query_id").orderBy(F.desc("picked"), "rank")
    return picked.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select("query_id", "pos", "global_id")


def mmr(rows: DataFrame, trade: float = 0.7, cap: int = 3, gap: float = 10.0, limit: int = 100) -> DataFrame:
    """Greedy maximal marginal relevance per query; relevance is the place in the list, not the score."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        v = np.array(pdf["v"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        n = len(pdf)
        relevance, nearest, free = 1 - np.arange(n) / n, np.zeros(n), np.ones(n, bool)
        order: list[int] = []
        while len(order) < limit and free.any():
            gain = np.where(free, trade * relevance - (1 - trade) * nearest, -np.inf)
            i = int(gain.argmax())
            free[i] = False
            same = [j for j in order if pdf.video_id[j] == pdf.video_id[i]]
            if len(same) >= cap or any(abs(pdf.pts_time[j] - pdf.pts_time[i]) < gap for j in same):
                continue
            order.append(i)
            nearest = np.maximum(nearest, v @ v[i]) if len(order) > 1 else v @ v[i]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[order], "pos": np.arange(1, len(order) + 1), "global_id": pdf["global_id"].iloc[order]})

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, pos int, global_id long")


def promote_unanimous(rows: DataFrame, below: float = 0.5) -> DataFrame:
    """Puts the first group of two or more equal answers in front when the top group disagrees."""
    same = F.count("*").over(Window.partitionBy("query_id", "grp", "answer"))
    told = rows.withColumn("c", same)
    votes = told.groupBy("query_id", "grp").agg(F.count("*").alias("n"), F.max("c").alias("c"))
    pick = votes.groupBy("query_id").agg(F.min(F.when((F.col("c") == F.col("n")) & (F.col("n") >= 2), F.col("grp"))).alias("promoted"), F.max(F.when(F.col("grp") == 1, F.col("c") / F.col("n"))).alias("agree"))
    front = (F.col("agree") < below) & (F.col("grp") == F.col("promoted"))
    w = Window.partitionBy("query_id").orderBy(F.when(front, 0).otherwise(1), "rank")
    joined = rows.join(pick, "query_id").withColumn("pos", F.row_number().over(w))
    return joined.drop("rank", "promoted", "agree").withColumnRenamed("pos", "rank")
