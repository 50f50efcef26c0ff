"""Joins as queries (J*): equi, interval, semi, anti, as-of, self and full outer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators import bm25, evaluate
from .base import query


@query("join_manifest", "SELECT query_id, rank, global_id, c.video_id, c.n FROM top64 JOIN catalog c USING (global_id)")
def join_manifest(t):
    return t.lane_top("visual").join(t.catalog, "global_id").select("query_id", "rank", "global_id", "video_id", "n")


_SEG = "seg AS (SELECT printf('L%02d_V%03d', CAST(video_id // 10 + 1 AS INTEGER), CAST(video_id % 10 + 1 AS INTEGER)) AS video_id, start, stop, text, turn FROM segments)"


def spoken(t):
    """Speech segments of the catalog's videos."""
    v = F.format_string("L%02d_V%03d", F.floor(F.col("video_id") / 10).cast("int") + 1, (F.col("video_id") % 10 + 1).cast("int"))
    return t.segments.withColumn("video_id", v)


@query("asr_interval_join", f"WITH {_SEG} SELECT c.global_id, s.turn, s.start FROM catalog c JOIN seg s ON s.video_id = c.video_id AND c.pts_time BETWEEN s.start - 2 AND s.stop + 2")
def asr_interval_join(t):
    s = spoken(t)
    return t.catalog.join(s, "video_id").where("pts_time between start - 2 and end + 2").select("global_id", "turn", "start")


@query("candidate_semi_join", "SELECT b.query_id, b.key, round(b.score, 6) AS score FROM bm25 b JOIN top64 t ON t.query_id = b.query_id AND t.global_id = b.key")
def candidate_semi_join(t):
    top = t.lane_top("visual").select("query_id", F.col("global_id").alias("key"))
    return bm25.score(t.text_docs, t.asked_texts, top).withColumn("score", F.round("score", 6))


@query("metadata_broadcast", "WITH v AS (SELECT video_id, avg(label) AS score FROM catalog GROUP BY video_id) SELECT global_id, round(score, 6) AS score FROM catalog JOIN v USING (video_id)")
def metadata_broadcast(t):
    video = t.catalog.groupBy("video_id").agg(F.avg("label").alias("score"))
    return t.catalog.join(video, "video_id").select("global_id", F.round("score", 6).alias("score"))


@query("knn_cross_join", "SELECT query_id, global_id, round(score, 6) AS score FROM a64")
def knn_cross_join(t):
    return t.all_scores(t.vectors).withColumn("score", F.round("score", 6))


@query("self_similarity_join", "SELECT a.query_id, a.global_id AS a, b.global_id AS b, round(list_dot_product(va.v, vb.v), 6) AS sim FROM top64 a JOIN top64 b ON a.query_id = b.query_id AND a.global_id <> b.global_id JOIN vectors va ON va.global_id = a.global_id JOIN vectors vb ON vb.global_id = b.global_id WHERE a.rank <= 20 AND b.rank <= 20")
def self_similarity_join(t):
    pool = t.lane_top("visual", 20).select("query_id", "global_id").join(t.vectors, "global_id")
    a, b = pool.select("query_id", F.col("global_id").alias("a"), F.col("v").alias("va")), pool.select("query_id", F.col("global_id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "query_id").where("a <> b").select("query_id", "a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("sim"))


@query("neighbor_offset_join", "SELECT t.query_id, t.global_id, o.d, c.global_id AS neighbor FROM top64 t, (VALUES (-2::BIGINT), (-1), (1), (2)) AS o(d) JOIN catalog a ON a.global_id = t.global_id JOIN catalog c ON c.global_id = t.global_id + o.d AND c.video_id = a.video_id")
def neighbor_offset_join(t):
    top = t.with_video(t.lane_top("visual")).select("query_id", "global_id", "video_id", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("d")).withColumn("neighbor", F.col("global_id") + F.col("d"))
    inside = t.catalog.select(F.col("global_id").alias("neighbor"), "video_id")
    return top.join(inside, ["neighbor", "video_id"]).select("query_id", "global_id", "d", "neighbor")


@query("grid_asof", "SELECT a.query_id, a.rank, a.frame_idx + 60 AS frame, max(g.frame_idx) FILTER (g.frame_idx <= a.frame_idx + 60) AS prev, min(g.frame_idx) FILTER (g.frame_idx > a.frame_idx + 60) AS next FROM run_a a JOIN catalog g USING (video_id) GROUP BY a.query_id, a.rank, a.frame_idx")
def grid_asof(t):
    asked = t.run("a").select("query_id", "rank", "video_id", (F.col("frame_idx") + 60).alias("frame"))
    # grid and requests in one ordered stream per video: the last grid frame at or before, the first after
    grid = t.catalog.select(F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("rank"), "video_id", F.col("frame_idx").alias("frame"), F.col("frame_idx").alias("grid"))
    line = asked.withColumn("grid", F.lit(None).cast("long")).unionByName(grid)
    w = Window.partitionBy("video_id").orderBy("frame", F.col("grid").isNull())
    told = line.withColumn("prev", F.last("grid", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.first("grid", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return told.where("grid is null").select("query_id", "rank", "frame", "prev", "next")


@query("asr_context", f"WITH {_SEG} SELECT c.global_id, left(string_agg(s.text, ' ' ORDER BY s.start), 800) AS context FROM catalog c JOIN seg s ON s.video_id = c.video_id AND s.start <= c.pts_time + 20 AND s.stop >= c.pts_time - 20 GROUP BY c.global_id")
def asr_context(t):
    near = t.catalog.join(spoken(t), "video_id").where("start <= pts_time + 20 and end >= pts_time - 20")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda s: s["text"]), " ")  # segments of 40 seconds
    return near.groupBy("global_id").agg(F.left(body, F.lit(800)).alias("context"))


@query("ocr_context", """
WITH near AS (SELECT a.global_id, c.n, d.text AS whole FROM catalog a JOIN catalog c ON c.video_id = a.video_id AND abs(c.n - a.n) <= 2 JOIN documents d ON d.doc_id = c.global_id),
firsts AS (SELECT global_id, left(whole, 600) AS s, min(n) AS n FROM near GROUP BY global_id, whole)
SELECT global_id, left(string_agg(s, ' | ' ORDER BY n, s), 600) AS context FROM firsts GROUP BY global_id""")
def ocr_context(t):
    docs = t.raw("documents").select(F.col("doc_id").alias("global_id"), F.left("text", F.lit(600)).alias("s"), F.sha2("text", 256).alias("whole"))  # the context ends at 600 characters; repeats are told by whole texts
    texts = t.catalog.select("global_id", "video_id", "n").join(docs, "global_id").select("video_id", "n", "s", "whole", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("center"))
    firsts = texts.groupBy("video_id", "center", "whole").agg(F.min("n").alias("n"), F.first("s").alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda r: r["s"]), " | ")  # five frames
    body = firsts.groupBy("video_id", "center").agg(F.left(joined, F.lit(600)).alias("context"))
    return t.catalog.select("global_id", "video_id", F.col("n").alias("center")).join(body, ["video_id", "center"]).select("global_id", "context")


@query("window_containment", "SELECT a.query_id, a.rank, bool_or(g.lo IS NOT NULL) AS hit FROM run_a a LEFT JOIN gt g ON g.query_id = a.query_id AND g.video_id = a.video_id AND a.frame_idx BETWEEN g.lo AND g.hi GROUP BY a.query_id, a.rank")
def window_containment(t):
    return evaluate.hits(t.run("a"), t.ground_truth).select("query_id", "rank", "hit")


@query("anti_missing", "SELECT DISTINCT query_id, event_idx FROM gt g WHERE NOT EXISTS (SELECT 1 FROM run_a a WHERE a.query_id = g.query_id AND a.video_id = g.video_id)")
def anti_missing(t):
    return t.ground_truth.select("query_id", "event_idx", "video_id").join(t.run("a").select("query_id", "video_id"), ["query_id", "video_id"], "left_anti").select("query_id", "event_idx").distinct()


@query("run_diff_full_outer", """
WITH a AS (SELECT * FROM run_a WHERE query_id <> 1 AND rank = 1), b AS (SELECT * FROM run_b WHERE query_id <> 5 AND rank = 1)
SELECT coalesce(a.query_id, b.query_id) AS query_id, CASE WHEN b.query_id IS NULL THEN 'only a' WHEN a.query_id IS NULL THEN 'only b' WHEN a.video_id = b.video_id AND a.frame_idx = b.frame_idx THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.query_id = b.query_id""")
def run_diff_full_outer(t):
    return evaluate.top1_diff(t.run("a").where("query_id <> 1"), t.run("b").where("query_id <> 5"))


@query("hamming_join", "WITH h AS (SELECT global_id, CAST('0x' || substr(md5(CAST(global_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM catalog) SELECT a.global_id AS a, b.global_id AS b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM h a JOIN h b ON a.global_id % 50 = 0")
def hamming_join(t):
    h = t.catalog.select("global_id", F.conv(F.substring(F.md5(F.col("global_id").cast("string")), 1, 15), 16, 10).cast("long").alias("h"))
    frames = h.where("global_id % 50 = 0").select(F.col("global_id").alias("a"), F.col("h").alias("ha"))  # the query set against all rows
    return frames.join(h.select(F.col("global_id").alias("b"), "h")).select("a", "b", F.bit_count(F.col("ha").bitwiseXOR(F.col("h"))).alias("distance"))
