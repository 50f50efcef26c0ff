"""Ordered event sequences: pooling, similarity tables, chain alignment, jitter, answers' votes."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_answer
from .fusion import minmax

# Openings of answers that decline to answer.
REFUSALS = r"^[^\p{L}\p{N}]*(không\s+(rõ|có\s+thông\s+tin|xác\s+định|thể\s+(xác\s+định|trả\s+lời)|biết|tìm\s+thấy|đủ\s+(thông\s+tin|dữ\s+liệu))|chưa\s+(rõ|xác\s+định|có\s+thông\s+tin)|unknown|n/?a|no\s+information|not\s+(available|enough|found|specified))(?![\p{L}\p{N}_])"


def is_non_answer(answer: Column) -> Column:
    """Empty, or a phrase that declines to answer."""
    return F.coalesce((F.trim(answer) == "") | F.lower(answer).rlike(REFUSALS), F.lit(True))


def pool_videos(event_hits: DataFrame, most: int = 30) -> DataFrame:
    """``query_id, video_id, score``: sum over events of a video's best hit (never below 0), best videos first."""
    best = event_hits.groupBy("query_id", "video_id", "event_idx").agg(F.greatest(F.lit(0.0), F.max("score")).alias("s"))
    total = best.groupBy("query_id", "video_id").agg(F.sum("s").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def align(sims: DataFrame, n_events: int, max_gap: float, min_gap: float = 0.0, floor: float = 0.1, penalty: float = 0.0005) -> DataFrame:
    """Best chain of frames for every last frame: ``query_id, video_id, last, score, frames, sims``.

    ``sims (query_id, video_id, n, time, event_idx, sim)``. Event j extends chains of event j - 1 in
    the same video by a later frame at most ``max_gap`` away; each step joins on the video and a time
    bin of that width (a frame's predecessors lie in its bin or the one before), followed by a maximum
    with map-side combine, so work grows with a video's length times the gap. Equal predecessors: the latest frame wins. The score
    is the penalised total over the number of events; ``sims`` are the raw ones.
    """
    base = sims.where(F.col("sim") >= floor)
    at = F.floor(F.col("time") / F.lit(max_gap * (1 + 1e-9) + 1e-9))
    now = base.where("event_idx = 0").select("query_id", "video_id", "n", "time", F.col("sim").alias("total"), F.array("n").alias("frames"), F.array("sim").alias("path"))
    for j in range(1, n_events):
        step = base.where(F.col("event_idx") == j).select("query_id", "video_id", F.col("n").alias("n2"), F.col("time").alias("t2"), "sim", at.alias("bin"))
        before = now.withColumn("bin", F.explode(F.array(at, at + 1)))
        pairs = before.join(step, ["query_id", "video_id", "bin"]).where((F.col("t2") > F.col("time")) & (F.col("t2") - F.col("time") >= min_gap) & (F.col("t2") - F.col("time") <= max_gap))
        gain = F.round(F.col("total") + F.lit(penalty) * F.col("time"), 9)  # equal sums stay equal
        best = pairs.groupBy("query_id", "video_id", "n2", "t2", "sim").agg(F.max_by(F.struct("total", "time", "frames", "path"), F.struct(gain.alias("g"), F.col("n"))).alias("b"))
        now = best.select("query_id", "video_id", F.col("n2").alias("n"), F.col("t2").alias("time"), (F.col("b.total") + F.col("sim") - F.lit(penalty) * (F.col("t2") - F.col("b.time"))).alias("total"), F.concat("b.frames", F.array("n2")).alias("frames"), F.concat("b.path", F.array("sim")).alias("path"))
    return now.select("query_id", "video_id", F.col("n").alias("last"), (F.col("total") / n_events).alias("score"), "frames", F.col("path").alias("sims"))


def _best_before(time: np.ndarray, gain: np.ndarray, t2: np.ndarray, min_gap: float, max_gap: float) -> np.ndarray:
    """For each of the ascending ``t2`` the largest gain of an earlier ascending ``time`` whose distance is allowed.

    A queue of falling gains holds the window's candidates, so each frame enters and leaves it once.
    """
    out, queue, entered = np.full(len(t2), -np.inf), deque(), 0
    for i, now in enumerate(t2):
        while entered < len(time) and time[entered] < now and now - time[entered] >= min_gap:
            while queue and gain[queue[-1]] <= gain[entered]:
                queue.pop()
            queue.append(entered)
            entered += 1
        while queue and now - time[queue[0]] > max_gap:
            queue.popleft()
        if queue:
            out[i] = gain[queue[0]]
    return out


def align_grouped(sims: DataFrame, n_events: int, max_gap: float, min_gap: float = 0.0, floor: float = 0.1, penalty: float = 0.0005) -> DataFrame:
    """The same chains by a dynamic programme per (query, video): linear in a video's frames."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["sim"] >= floor].sort_values(["event_idx", "time", "n"])
        layers = [g for _, g in pdf.groupby("event_idx")]
        if len(layers) < n_events:
            return pd.DataFrame({"query_id": [], "video_id": [], "last": [], "score": []}).astype({"query_id": "int64", "video_id": pdf["video_id"].dtype, "last": "int64", "score": "float64"})
        time, total = layers[0]["time"].to_numpy(), layers[0]["sim"].to_numpy()
        for g in layers[1:n_events]:
            t2, s2 = g["time"].to_numpy(), g["sim"].to_numpy()
            best = _best_before(time, total + penalty * time, t2, min_gap, max_gap) - penalty * t2
            keep = np.isfinite(best)
            time, total, last = t2[keep], (best + s2)[keep], g["n"].to_numpy()[keep]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "video_id": pdf["video_id"].iloc[0], "last": last, "score": total / n_events})

    return sims.groupBy("query_id", "video_id").applyInPandas(run, f"query_id long, video_id {sims.schema['video_id'].dataType.simpleString()}, last long, score double")


def beam(sims: DataFrame, n_events: int, width: int = 8, max_gap: float = 150.0, floor: float = 0.1) -> DataFrame:
    """Beam search per (query, video) for timelines that are not monotonic: best ``width`` chains."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["sim"] >= floor]
        chains = [(0.0, ())]
        for j in range(n_events):
            rows = pdf[pdf["event_idx"] == j].sort_values("n")
            grown = [(s + r.sim, (*c, (r.n, r.time))) for s, c in chains for r in rows.itertuples() if not c or 0 < r.time - c[-1][1] <= max_gap]
            grown.sort(key=lambda x: (-x[0], x[1]))
            kept, seen = [], set()
            for s, c in grown:  # chains that end alike are one direction of the beam
                if c[-1][0] not in seen:
                    seen.add(c[-1][0])
                    kept.append((s, c))
            chains = kept[:width]
        out = [(pdf["query_id"].iloc[0], pdf["video_id"].iloc[0], s / n_events, [int(n) for n, _ in c]) for s, c in chains if len(c) == n_events] if len(pdf) else []
        return pd.DataFrame(out, columns=["query_id", "video_id", "score", "frames"])

    return sims.groupBy("query_id", "video_id").applyInPandas(run, f"query_id long, video_id {sims.schema['video_id'].dataType.simpleString()}, score double, frames array<long>")


def monotonize(frames: Column) -> Column:
    """Strictly increasing frames: ties move up by one; null where the frames go down."""
    falls = F.exists(F.sequence(F.lit(1), F.size(frames) - 1), lambda i: F.get(frames, i) < F.get(frames, i - 1))
    lifted = F.aggregate(frames, F.array().cast("array<bigint>"), lambda a, f: F.concat(a, F.array(F.when(F.size(a) == 0, f).otherwise(F.greatest(f, F.element_at(a, -1) + 1)))))
    return F.when((F.size(frames) > 1) & falls, F.lit(None)).otherwise(lifted)


def reduce_variants(sims: DataFrame) -> DataFrame:
    return sims.groupBy("query_id", "video_id", "n", "event_idx").agg(F.max("sim").alias("sim"))


def ensemble(members: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per member and event min-max (flat: 0.5), then the mean weighted over the members present."""
    w = F.try_element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("member"))
    told = members.withColumn("w", w).withColumn("s", minmax(F.col("sim"), Window.partitionBy("query_id", "member", "event_idx"), 0.5))
    return told.groupBy("query_id", "video_id", "n", "event_idx").agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("sim"))


def add_captions(sims: DataFrame, captions: DataFrame, weight: float) -> DataFrame:
    """Adds weighted caption scores, min-maxed per event (flat: 0)."""
    c = captions.withColumn("c", minmax(F.col("caption"), Window.partitionBy("query_id", "event_idx"), 0.0)).select("query_id", "video_id", "n", "event_idx", "c")
    return sims.join(c, ["query_id", "video_id", "n", "event_idx"], "left").withColumn("sim", F.col("sim") + weight * F.coalesce("c", F.lit(0.0))).drop("c")


def jitter_variants(chains: DataFrame, grid: DataFrame) -> DataFrame:
    """Alternatives of each chain, in order and without repeats: midpoints to the frames before (all,
    then each), after (all, then each), and the frames before and after in place of each."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    near = grid.select("video_id", "frame_idx", F.coalesce(F.floor((F.lag("frame_idx").over(w) + F.col("frame_idx")) / 2), F.col("frame_idx")).alias("early"), F.coalesce(F.floor((F.col("frame_idx") + F.lead("frame_idx").over(w)) / 2), F.col("frame_idx")).alias("late"), F.coalesce(F.lag("frame_idx").over(w), F.col("frame_idx")).alias("p"), F.coalesce(F.lead("frame_idx").over(w), F.col("frame_idx")).alias("x"))
    each = chains.select("query_id", "rank", "video_id", F.posexplode("frames").alias("pos", "frame_idx")).join(near, ["video_id", "frame_idx"])
    told = each.groupBy("query_id", "rank", "video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "frame_idx", "early", "late", "p", "x"))).alias("a"))  # a chain's few frames
    told = told.join(chains.select("query_id", "rank", F.size("frames").alias("k")), ["query_id", "rank"]).where(F.size("a") == F.col("k"))

    def single(field: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.transform("a", lambda r, k: F.when(k == i, r[field]).otherwise(r["frame_idx"]).cast("long")))

    def whole(field: str) -> Column:
        return F.array(F.transform("a", lambda r: r[field].cast("long")))

    options = F.concat(whole("early"), single("early"), whole("late"), single("late"), single("p"), single("x"))
    from .rows import increasing

    good = F.filter(F.array_distinct(options), lambda f: (F.get(f, F.lit(0)) >= 0) & increasing(f) & (f != F.transform("a", lambda r: r["frame_idx"].cast("long"))))
    return told.select("query_id", "rank", "video_id", F.posexplode(good).alias("j", "frames"))


def expand_jitter(chains: DataFrame, variants: DataFrame, mapped: DataFrame, legacy: int = 8, videos: int = 4, limit: int = 100) -> DataFrame:
    """First rows verbatim, variant blocks of the best chain of the first videos, then the rest."""
    from .rows import dedupe_first, rerank

    best = dedupe_first(chains.join(mapped, "video_id", "left_semi"), ["video_id"])
    best = rerank(best.withColumn("old", F.col("rank")), "rank", limit=videos).select("query_id", F.col("rank").alias("block"), F.col("old").alias("rank"))
    fresh = variants.join(best, ["query_id", "rank"]).select("query_id", "video_id", "frames", F.lit(1).alias("part"), "block", F.col("j").cast("int").alias("at"))
    own = chains.select("query_id", "video_id", "frames", F.when(F.col("rank") <= legacy, 0).otherwise(2).alias("part"), F.lit(0).alias("block"), F.col("rank").cast("int").alias("at"))
    every = rerank(own.unionByName(fresh), "part", "block", "at", "frames")
    return rerank(dedupe_first(every, ["video_id", "frames"]), "rank", limit=limit).select("query_id", "rank", "video_id", "frames")


def match_monotonic(costs: DataFrame, n_hashes: int) -> DataFrame:
    """Cheapest non-decreasing assignment of hashes 0..K-1 to positions, per video: one window scan a step.

    ``costs (video_id, hash_no, position, cost)``; returns ``video_id, total, positions``.
    """
    scan = Window.partitionBy("video_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    now = costs.where("hash_no = 0").select("video_id", "position", F.col("cost").cast("double").alias("total"), F.array("position").alias("path"))
    for k in range(1, n_hashes):
        best = now.withColumn("b", F.min(F.struct("total", F.col("position").alias("at"), "path")).over(scan)).select("video_id", "position", "b")
        now = costs.where(F.col("hash_no") == k).join(best, ["video_id", "position"]).select("video_id", "position", (F.col("b.total") + F.col("cost")).alias("total"), F.concat("b.path", F.array("position")).alias("path"))
    return now.groupBy("video_id").agg(F.min(F.struct("total", "path")).alias("m")).select("video_id", "m.total", F.col("m.path").alias("positions"))


def grid_ceiling(inside: DataFrame, n_events: int) -> DataFrame:
    """Most events that strictly increasing grid frames can hit: ``inside (query_id, video_id, frame_idx, event_idx)``."""
    w = Window.partitionBy("query_id", "video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    frames = inside.groupBy("query_id", "video_id", "frame_idx").agg(*[F.bool_or(F.col("event_idx") == j).alias(f"e{j}") for j in range(n_events)])
    now = frames.withColumn("best", F.lit(0))
    # best[j] at a frame: hits of events up to j with this frame as the last one used
    before = F.lit(0)
    for j in range(n_events):
        now = now.withColumn(f"d{j}", F.when(F.col(f"e{j}"), before + 1).otherwise(F.lit(0)))
        upto = F.greatest(F.lit(0), *[F.col(f"d{i}") for i in range(j + 1)]) if j else F.col("d0")
        now = now.withColumn(f"u{j}", F.coalesce(F.max(upto).over(w), F.lit(0)))
        before = F.col(f"u{j}")
    top = F.greatest(F.lit(0), *[F.col(f"d{j}") for j in range(n_events)])
    return now.groupBy("query_id", "video_id").agg(F.max(top).alias("ceiling"))


def majority_vote(ballots: DataFrame, key: Column) -> DataFrame:
    """``group_id, answer, votes, total``: the commonest class, first seen on ties; its first ballot stands for it."""
    told = ballots.where(F.trim("ballot") != "").withColumn("k", key)
    counts = told.groupBy("group_id", "k").agg(F.count("*").alias("votes"), F.min(F.struct("pos", "ballot")).alias("first"))
    out = counts.groupBy("group_id").agg(F.max_by(F.struct("first", "votes"), F.struct("votes", (-F.col("first.pos")).alias("p"))).alias("b"), F.sum("votes").alias("total"))
    return out.select("group_id", F.col("b.first.ballot").alias("answer"), F.col("b.votes").alias("votes"), "total")


def answers_agree(a: Column, b: Column) -> Column:
    return normalize_answer(a) == normalize_answer(b)
