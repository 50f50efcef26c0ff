"""Sort, limit, top-k and set operations as queries (T*, U*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, fusion, greedy, rows
from .aggregates import _CONF, W, confidences, rounded
from .base import query
from .scans import _BOTH, both_runs


@query("dense_topk", "SELECT query_id, global_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) AS rank FROM a64) WHERE rank <= 100")
def dense_topk(t):
    return rounded(t.best(t.vectors, t.query_set(t.vectors), 100)).select("query_id", "global_id", "score", "rank")


@query("ann_topk_ivf")
def ann_topk_ivf(t):
    """Clustered search in the index on disk: nearest cells first, exact scores inside them."""
    return rounded(t.vector_index().search(t.query_set(t.vectors), k=10, probes=6)).select("query_id", "rank", "global_id", "score")


@query("ann_topk_hnsw")
def ann_topk_hnsw(t):
    """Hierarchical graph search in the index on disk, block by block."""
    return rounded(t.graph_index().search(t.query_set(t.vectors), k=10)).select("query_id", "rank", "global_id", "score")


@query("final_rank", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, global_id) AS rank FROM fused)
SELECT r.query_id, rank, c.global_id, c.video_id, c.frame_idx, round(round(score, 9), 6) AS score, n.signals FROM r JOIN catalog c USING (global_id) JOIN (SELECT query_id, global_id, string_agg(signal, ',' ORDER BY signal) AS signals FROM signals GROUP BY ALL) n ON n.query_id = r.query_id AND n.global_id = r.global_id WHERE rank <= 120""")
def final_rank(t):
    top = fusion.top_k(fusion.weighted_sum(t.signals, W).withColumn("score", F.round("score", 9)), 120, ["query_id"])
    maps = fusion.signal_map(t.signals).select("query_id", "global_id", F.array_join(F.map_keys("signals"), ",").alias("signals"))
    out = top.join(t.catalog.select("global_id", "video_id", "frame_idx"), "global_id").join(maps, ["query_id", "global_id"])
    return rounded(out).select("query_id", "rank", "global_id", "video_id", "frame_idx", "score", "signals")


@query("nearest", "SELECT query_id, global_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) AS r FROM a64 WHERE global_id <> query_id) WHERE r <= 12")
def nearest(t):
    return rounded(fusion.top_k(t.all_scores(t.vectors).where("global_id <> query_id"), 12, ["query_id"])).select("query_id", "global_id", "score")


def _display(t):
    top = t.lane_top("visual")
    return top.join(t.catalog.select("global_id", "video_id", "pts_time"), "global_id")


@query("avs_diversify_greedy")
def avs_diversify_greedy(t):
    return greedy.diversify(_display(t), 3, 10.0, 60)


@query("avs_mmr")
def avs_mmr(t):
    return greedy.mmr(_display(t).join(t.vectors.select("global_id", "v"), "global_id"), limit=40)


@query("select_weak", f"WITH {_CONF} SELECT query_id, confidence FROM (SELECT *, row_number() OVER (ORDER BY confidence, query_id) AS p, count(*) OVER () AS n FROM conf) WHERE confidence < 0.8 AND p <= ceil(0.5 * n)")
def select_weak(t):
    return evaluate.select_weak(confidences(t), 0.8, 0.5)


@query("order_query_files", "SELECT item_id, row_number() OVER (ORDER BY CASE item_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, name) AS pos FROM (SELECT item_id, 'query-' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS name FROM benchmark)")
def order_query_files(t):
    names = t.raw("benchmark").select("item_id", F.concat(F.lit("query-"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("name"))
    task = F.when((F.col("item_id") % 4).isin(0, 3), 0).when(F.col("item_id") % 4 == 1, 1).otherwise(2)
    return names.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(task, "name"))).select("item_id", "pos")  # one pack


@query("candidate_union", "SELECT query_id, count(DISTINCT global_id) AS n FROM signals GROUP BY query_id")
def candidate_union(t):
    ids = t.signals.select("query_id", "global_id").distinct()
    return ids.groupBy("query_id").agg(F.count("*").alias("n"))


@query("topk_overlap", "SELECT a.query_id, round(count(*) / 20.0, 6) AS overlap FROM (SELECT * FROM run_a WHERE rank <= 20) a JOIN (SELECT * FROM run_b WHERE rank <= 20) b USING (query_id, video_id, frame_idx) GROUP BY a.query_id")
def topk_overlap(t):
    keys = ["query_id", "video_id", "frame_idx"]
    both = t.run("a").where("rank <= 20").select(*keys).intersect(t.run("b").where("rank <= 20").select(*keys))
    return both.groupBy("query_id").agg(F.round(F.count("*") / 20.0, 6).alias("overlap"))


@query("dedupe_first", f"WITH {_BOTH} SELECT query_id, rank, video_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, frame_idx ORDER BY rank) AS d FROM both_runs) WHERE d = 1")
def dedupe_first(t):
    return rows.dedupe_first(both_runs(t), ["video_id", "frame_idx"]).select("query_id", "rank", "video_id", "frame_idx")


@query("texts_for_search", """
WITH v AS (SELECT item_id, unnest([text, lower(text), left(text, 20), left(text, 20)]) AS t, unnest([0, 1, 2, 3]) AS pos FROM benchmark)
SELECT item_id, t AS text, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM (SELECT item_id, arg_min(t, pos) AS t, min(pos) AS pos FROM v GROUP BY item_id, lower(t))""")
def texts_for_search(t):
    v = t.raw("benchmark").select("item_id", F.posexplode(F.array("text", F.lower("text"), F.left("text", F.lit(20)), F.left("text", F.lit(20)))).alias("pos", "text"))
    firsts = v.groupBy("item_id", F.lower("text").alias("k")).agg(F.min(F.struct("pos", "text")).alias("m"))
    return firsts.select("item_id", "m.text", F.row_number().over(Window.partitionBy("item_id").orderBy("m.pos")).alias("n"))


@query("except_missing", "SELECT query_id, video_id FROM gt EXCEPT SELECT query_id, video_id FROM run_a")
def except_missing(t):
    return t.ground_truth.select("query_id", "video_id").subtract(t.run("a").select("query_id", "video_id"))


@query("multi_channel_union", "SELECT source, count(*) AS n, CAST(sum(dim) AS BIGINT) AS dims FROM (SELECT 'corpus' AS source, len(v) AS dim FROM vectors UNION ALL SELECT 'public', len(v) FROM lane32) GROUP BY source")
def multi_channel_union(t):
    corpus = t.vectors.select(F.lit("corpus").alias("source"), "v", "label")
    public = t.lane32.select(F.lit("public").alias("source"), "v")
    return corpus.unionByName(public, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("dims"))

