"""Ranked answer rows: dedupe, caps, diversity, budgets, merging. ``rank`` is always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_answer
from ..sources.files import VIDEO_ID


def rerank(rows: DataFrame, *order, limit: int | None = None) -> DataFrame:
    """New positions from 1 inside each query."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.where(F.col("rank") <= limit) if limit else out


def dedupe_first(rows: DataFrame, keys: list, order="rank") -> DataFrame:
    """The best-ranked row of each key inside its query."""
    w = Window.partitionBy("query_id", *keys).orderBy(order)
    return rows.withColumn("__d", F.row_number().over(w)).where("__d = 1").drop("__d")


def _valid(video: str = VIDEO_ID) -> Column:
    return F.col("video_id").rlike(video)


def kis_rows(rows: DataFrame, limit: int = 100) -> DataFrame:
    return rerank(dedupe_first(rows.where(_valid() & (F.col("frame_idx") >= 0)), ["video_id", "frame_idx"]), "rank", limit=limit)


def qa_rows(rows: DataFrame, limit: int = 100, video: str = VIDEO_ID) -> DataFrame:
    told = rows.where(_valid(video) & (F.col("frame_idx") >= 0)).withColumn("key", F.lower(sanitize_answer(F.col("answer"))))
    return rerank(dedupe_first(told, ["video_id", "frame_idx", "key"]).drop("key"), "rank", limit=limit)


def increasing(frames: Column) -> Column:
    """Whether an array grows strictly; an empty one does not count."""
    return (F.size(frames) > 0) & F.forall(F.zip_with(F.slice(frames, 1, F.size(frames) - 1), F.slice(frames, 2, F.size(frames)), lambda a, b: F.coalesce(b > a, F.lit(False))), lambda x: x)


def trake_rows(rows: DataFrame, limit: int = 100, video: str = VIDEO_ID) -> DataFrame:
    ok = rows.where(_valid(video) & increasing(F.col("frames")))
    return rerank(dedupe_first(ok, ["video_id", "frames"]), "rank", limit=limit)


def issues(rows: DataFrame, limit: int = 100, answer_chars: int = 100) -> DataFrame:
    """``query_id, rank, issue`` of malformed rows; rank 0 marks an issue of the whole list."""
    again = F.col("__again") > 1
    placed = rows.withColumn("__again", F.row_number().over(Window.partitionBy("query_id", "video_id", "frame_idx").orderBy("rank")))
    told = placed.select("query_id", "rank", F.explode(F.array_compact(F.array(
        F.when(~_valid(), "video"), F.when(F.col("frame_idx") < 0, "frame"), F.when(again, "duplicate"),
        F.when(F.trim("answer") == "", "blank answer"), F.when(F.length("answer") > answer_chars, "long answer"),
    ))).alias("issue"))
    whole = rows.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") > limit)
    return told.unionByName(whole.select("query_id", F.lit(0).cast(rows.schema["rank"].dataType).alias("rank"), F.lit("too many rows").alias("issue")))


def head_diversify(rows: DataFrame, windows=((5, 2), (20, 5))) -> DataFrame:
    """Caps a video's rows inside each head window; excess rows follow right after it, order kept."""
    out = rows
    for size, cap in windows:
        mine = F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("rank"))
        out = out.withColumn("__ok", (mine <= cap).cast("int"))
        out = out.withColumn("__run", F.sum("__ok").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
        head = (F.col("__ok") == 1) & (F.col("__run") <= size)
        out = rerank(out, F.when(head, 0).otherwise(1), "rank").drop("__ok", "__run")
    return out


def round_robin(groups: DataFrame, budget: int, most: int) -> DataFrame:
    """``query_id, grp, extras``: a budget dealt to groups in turns, at most ``most`` each."""
    turns = groups.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return rerank(turns, "turn", "grp", limit=budget).groupBy("query_id", "grp").agg(F.count("*").alias("extras"))


def diversify_tail(rows: DataFrame, variants: DataFrame, head: int = 30, budget: int = 100, share: float = 0.5) -> DataFrame:
    """Head verbatim, then round-robin variants of the head videos' first rows, then the old tail.

    ``variants (video_id, frame_idx, j, variant_frame)`` are a grid frame's alternatives in order.
    """
    size = F.count("*").over(Window.partitionBy("query_id"))
    told = rows.withColumn("__n", size)
    anchors = dedupe_first(told.where((F.col("rank") <= head) & (F.col("__n") > head)), ["video_id"])
    fresh = anchors.select("query_id", F.col("rank").alias("anchor"), "video_id", "frame_idx").join(variants, ["video_id", "frame_idx"]).select("query_id", "anchor", "j", "video_id", F.col("variant_frame").alias("frame_idx"))
    fresh = fresh.join(rows.select("query_id", "video_id", "frame_idx"), ["query_id", "video_id", "frame_idx"], "left_anti")
    fresh = dedupe_first(fresh.withColumn("rank", F.col("j") * 1000 + F.col("anchor")), ["video_id", "frame_idx"])
    fresh = rerank(fresh, "rank", limit=int((budget - head) * share))
    block = F.when(F.col("rank") <= head, 0).otherwise(2)
    every = rows.select("query_id", "video_id", "frame_idx", block.alias("block"), "rank").unionByName(fresh.select("query_id", "video_id", "frame_idx", F.lit(1).alias("block"), "rank"))
    return rerank(every, "block", "rank", limit=budget)


def variant_frames(grid: DataFrame) -> DataFrame:
    """Four alternatives of each grid frame: midpoints to the frames before and after, and these frames."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    told = grid.select("video_id", "frame_idx", F.lag("frame_idx").over(w).alias("p"), F.lead("frame_idx").over(w).alias("x"))
    f = F.col("frame_idx")
    options = F.array(F.floor((F.col("p") + f) / 2), F.floor((f + F.col("x")) / 2), F.col("p"), F.col("x"))
    each = told.select("video_id", "frame_idx", F.posexplode(options).alias("j", "variant_frame"))
    return each.where("variant_frame is not null and variant_frame <> frame_idx")


def merge_runs(runs: DataFrame, weights: dict[str, float], k: int = 60, keys=("video_id", "frame_idx"), limit: int = 100) -> DataFrame:
    """Weighted reciprocal rank fusion of ``run, query_id, rank`` rows.

    The best-ranked run supplies the row (the earlier run on ties); ties of the sum follow first
    encounter: run, then rank.
    """
    w = F.create_map(*[F.lit(x) for name, v in weights.items() for x in (name, float(v))])
    first = F.struct("run", "rank")
    merged = runs.groupBy("query_id", *keys).agg(F.sum(F.try_element_at(w, F.col("run")) / (k + F.col("rank"))).alias("score"), F.min(first).alias("seen"), F.min_by("answer", F.struct("rank", "run")).alias("answer"))
    return rerank(merged, F.desc("score"), "seen.run", "seen.rank", limit=limit).drop("seen")


def answer_variants_tail(rows: DataFrame, variants: DataFrame, head: int = 30, extra: int = 10, limit: int = 100) -> DataFrame:
    """Puts alternate spellings of the head's answers at the end, replacing the last rows."""
    firsts = rows.where(F.col("rank") <= head).join(variants, "answer").select("query_id", "video_id", "frame_idx", F.col("variant").alias("answer"), "rank")
    firsts = firsts.join(rows.select("query_id", "video_id", "frame_idx", "answer"), ["query_id", "video_id", "frame_idx", "answer"], "left_anti")
    added = rerank(dedupe_first(firsts, ["answer"]), "rank", "answer", limit=extra)
    return _replace_tail(rows, added, limit)


def _replace_tail(rows: DataFrame, added: DataFrame, limit: int) -> DataFrame:
    n = added.groupBy("query_id").agg(F.count("*").alias("__added"))
    kept = rows.join(n, "query_id", "left").where(F.col("rank") <= limit - F.coalesce("__added", F.lit(0)))
    every = kept.select("query_id", "video_id", "frame_idx", "answer", F.lit(0).alias("block"), "rank").unionByName(added.select("query_id", "video_id", "frame_idx", "answer", F.lit(1).alias("block"), "rank"))
    return rerank(every, "block", "rank", limit=limit)


def hedge_tail(rows: DataFrame, other: DataFrame, head: int = 20, extra: int = 10, limit: int = 100) -> DataFrame:
    """Adds the other run's differing answers for the head's frames at the end."""
    asked = rows.where(F.col("rank") <= head).select("query_id", "video_id", "frame_idx", "rank")
    theirs = dedupe_first(other, ["video_id", "frame_idx"]).select("query_id", "video_id", "frame_idx", "answer")
    got = asked.join(theirs, ["query_id", "video_id", "frame_idx"])
    got = got.withColumn("key", F.lower("answer")).join(rows.select("query_id", "video_id", "frame_idx", F.lower("answer").alias("key")), ["query_id", "video_id", "frame_idx", "key"], "left_anti").drop("key")
    return _replace_tail(rows, rerank(got, "rank", limit=extra), limit)


def group_candidates(rows: DataFrame, max_seconds: float = 10.0, max_frames: int = 250) -> DataFrame:
    """Adds ``grp`` (1 for the group with the best rank): runs of close frames inside a video."""
    w = Window.partitionBy("query_id", "video_id").orderBy("frame_idx", "rank")
    gap_t, gap_f = F.col("pts_time") - F.lag("pts_time").over(w), F.col("frame_idx") - F.lag("frame_idx").over(w)
    new = F.lag("frame_idx").over(w).isNull() | F.coalesce(gap_t > max_seconds, F.lit(False)) | (gap_f > max_frames)
    told = rows.withColumn("__new", new.cast("int")).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("__best", F.min("rank").over(Window.partitionBy("query_id", "video_id", "__g")))
    return told.withColumn("grp", F.dense_rank().over(Window.partitionBy("query_id").orderBy("__best"))).drop("__new", "__g", "__best")
