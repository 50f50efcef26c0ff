"""Vector and rerank operators as queries (V*)."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.vectors import dot, interpolate, norm
from ..operators import bm25, evaluate, fusion, rerank
from .aggregates import _MARGIN, W, rounded
from .base import query
from .windows import _BOOST, _CONSIST

_MIN = """
WITH r AS (SELECT query_id, global_id, sum(score * CASE signal WHEN 'visual' THEN 0.6 ELSE 0.4 END) AS score FROM normed WHERE signal <> 'object' GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, global_id) AS rank FROM r)
SELECT query_id, rank, c.global_id, c.video_id, c.frame_idx, round(round(score, 9), 6) AS score FROM p JOIN catalog c USING (global_id) WHERE rank <= 20"""


@query("fuse_signals_min", _MIN)
def fuse_signals_min(t):
    """Fused search over two vector lanes: top 100 a lane, min-max, .6 / .4, best 20."""
    lanes = t.signals.where("signal <> 'object'")
    top = fusion.top_k(fusion.weighted_sum(lanes, {"visual": 0.6, "alt": 0.4}).withColumn("score", F.round("score", 9)), 20, ["query_id"])
    return rounded(top.join(t.catalog, "global_id")).select("query_id", "rank", "global_id", "video_id", "frame_idx", "score")


@query("cosine_sim", "SELECT q.global_id AS a, c.global_id AS b, round(list_cosine_similarity(q.v, c.v), 6) AS sim FROM vectors q JOIN vectors c ON q.global_id % 50 = 0")
def cosine_sim(t):
    v = t.vectors.select("global_id", "v", norm(F.col("v")).alias("n"))
    asked = v.where("global_id % 50 = 0")
    a, b = asked.select(F.col("global_id").alias("a"), F.col("v").alias("va"), F.col("n").alias("na")), v.select(F.col("global_id").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    return a.join(b).select("a", "b", F.round(dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb")), 6).alias("sim"))


def _mean(v: str) -> str:
    return "list_transform(range(1, 65), lambda i: list_avg(list_transform(" + v + ", lambda x: x[i])))"


_SG = f"""pool AS (SELECT t.query_id, t.global_id, list_transform(v.v, lambda x: x / sqrt(list_dot_product(v.v, v.v))) AS u FROM top64 t JOIN vectors v USING (global_id) WHERE t.rank <= 40),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id, global_id ORDER BY s DESC, other) AS r FROM (SELECT a.query_id, a.global_id, b.global_id AS other, b.u AS ub, list_dot_product(a.u, b.u) AS s FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.global_id <> b.global_id)),
around AS (SELECT query_id, global_id, {_mean('list(ub)')} AS m FROM nn WHERE r <= 10 GROUP BY ALL),
qq AS (SELECT global_id // 50 AS query_id, v AS q FROM vectors WHERE global_id % 50 = 0),
base AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, global_id) AS r FROM (SELECT p.*, q, list_dot_product(u, q) AS s FROM pool p JOIN qq USING (query_id))),
head AS (SELECT query_id, any_value(q) AS q, {_mean('list(u)')} AS hm FROM base WHERE r <= 10 GROUP BY query_id),
q2 AS (SELECT query_id, list_transform(range(1, 65), lambda i: q[i] + hm[i]) AS w FROM head),
ref AS (SELECT b.query_id, b.global_id, b.u, b.q, list_transform(range(1, 65), lambda i: u[i] + m[i]) AS w FROM base b JOIN around USING (query_id, global_id)),
sg AS (SELECT r.query_id, r.global_id, (list_dot_product(r.w, r.q) / sqrt(list_dot_product(r.w, r.w)) + list_dot_product(r.u, q2.w) / sqrt(list_dot_product(q2.w, q2.w))) / 2 AS score FROM ref r JOIN q2 USING (query_id))"""


@query("superglobal_rerank", f"WITH {_SG} SELECT query_id, global_id, round(score, 6) AS score FROM sg")
def superglobal_rerank(t):
    return rounded(rerank.superglobal(_pool(t), t.queries(t.vectors), 64))


def _pool(t):
    return t.lane_top("visual", 40).select("query_id", "global_id").join(t.vectors.select("global_id", "v"), "global_id")


_ROC = f"""moved AS (SELECT q.query_id, list_transform(range(1, 65), lambda i: q.v[i] + 0.75 * p.m[i] - 0.15 * n.m[i]) AS w FROM (SELECT global_id // 50 AS query_id, v FROM vectors WHERE global_id % 50 = 0) q
  JOIN (SELECT query_id, {_mean('list(v.v)')} AS m FROM top64 JOIN vectors v USING (global_id) WHERE rank BETWEEN 2 AND 4 GROUP BY query_id) p USING (query_id)
  JOIN (SELECT query_id, {_mean('list(v.v)')} AS m FROM top64 JOIN vectors v USING (global_id) WHERE rank BETWEEN 90 AND 95 GROUP BY query_id) n USING (query_id)),
fb AS (SELECT m.query_id, c.global_id, list_dot_product(m.w, c.v) / sqrt(list_dot_product(m.w, m.w)) AS score FROM moved m, vectors c)"""


@query("rocchio", f"WITH {_ROC} SELECT query_id, global_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) AS r FROM fb) WHERE r <= 50")
def rocchio(t):
    told = t.lane_top("visual").join(t.vectors.select("global_id", "v"), "global_id")
    moved = rerank.rocchio(t.queries(t.vectors), told.where("rank between 2 and 4"), told.where("rank between 90 and 95"), 64)
    return rounded(t.best(t.vectors, moved, 50)).select("query_id", "global_id", "score")


@query("dense_scores", f"""
WITH {_SG}, lanes AS (SELECT query_id, 'a' AS lane, global_id, score FROM sg UNION ALL SELECT query_id, 'b', global_id, score FROM top32 WHERE rank <= 40),
nrm AS (SELECT *, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM lanes WINDOW w AS (PARTITION BY query_id, lane))
SELECT query_id, global_id, round(sum(s * CASE lane WHEN 'a' THEN 0.6 ELSE 0.4 END), 6) AS score FROM nrm GROUP BY ALL""")
def dense_scores(t):
    a = rerank.superglobal(_pool(t), t.queries(t.vectors), 64).withColumn("signal", F.lit("a"))
    b = t.lane_top("alt", 40).select("query_id", "global_id", "score", F.lit("b").alias("signal"))
    return rounded(fusion.weighted_sum(a.unionByName(b), {"a": 0.6, "b": 0.4}))


@query("search_image", "SELECT 0::BIGINT AS query_id, global_id, round(score, 6) AS score FROM (SELECT global_id, list_dot_product(v, q) AS score, row_number() OVER (ORDER BY list_dot_product(v, q) DESC, global_id) AS r FROM vectors, (SELECT v AS q FROM vectors WHERE global_id = 77)) WHERE r <= 30")
def search_image(t):
    image = t.vectors.where("global_id = 77").select(F.lit(0).alias("query_id"), F.col("v").alias("qv"))
    s = t.vectors.join(F.broadcast(image)).select("query_id", "global_id", dot(F.col("qv"), F.col("v")).alias("score"))
    return rounded(fusion.top_k(s, 30, ["query_id"])).select("query_id", "global_id", "score")


@query("fuse_signals", f"""
WITH texts AS (SELECT b.query_id, 'ocr' AS signal, b.key AS global_id, b.score FROM bm25 b JOIN top64 t ON t.query_id = b.query_id AND t.global_id = b.key),
every AS (SELECT * FROM signals UNION ALL SELECT * FROM texts),
nrm AS (SELECT query_id, signal, global_id, CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM every WINDOW w AS (PARTITION BY query_id, signal))),
fusedv AS (SELECT query_id, global_id, sum(s * CASE signal WHEN 'visual' THEN 0.6 WHEN 'alt' THEN 0.4 WHEN 'ocr' THEN 0.35 ELSE 0.25 END) AS score, printf('L%02d_V%03d', CAST(global_id // 200 + 1 AS INTEGER), CAST(global_id // 20 % 10 + 1 AS INTEGER)) AS video_id FROM nrm GROUP BY query_id, global_id),
{_CONSIST}, {_BOOST.format(src='cons')}
SELECT query_id, rank, global_id, round(round(score, 9), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, global_id) AS rank FROM boosted) WHERE rank <= 120""")
def fuse_signals(t):
    """Fusion of dense, text and object signals, then consistency and neighbour boosts, then the cut."""
    top = t.lane_top("visual").select("query_id", F.col("global_id").alias("key"))
    ocr = bm25.score(t.text_docs, t.asked_texts, top).select("query_id", F.lit("ocr").alias("signal"), F.col("key").alias("global_id"), "score")
    fused = t.with_video(fusion.weighted_sum(t.signals.unionByName(ocr), W | {"ocr": 0.35}))
    boosted = fusion.neighbor_boost(fusion.consistency_boost(fused)).withColumn("score", F.round("score", 9))
    return rounded(fusion.top_k(boosted, 120, ["query_id"])).select("query_id", "rank", "global_id", "score")


@query("context_boost", """
WITH ctx AS (SELECT s.query_id, c.video_id, s.global_id, s.score AS sim FROM s32 s JOIN catalog c USING (global_id)),
near AS (SELECT query_id, global_id, max(sim) OVER (PARTITION BY query_id, video_id ORDER BY global_id RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS near FROM ctx),
p AS (SELECT f.query_id, f.global_id, f.score, coalesce(n.near, 0) AS near, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.global_id) <= 200 AS head FROM fused f LEFT JOIN near n USING (query_id, global_id)),
m AS (SELECT *, min(score) OVER w AS sl, max(score) OVER w AS sh, min(near) OVER w AS nl, max(near) OVER w AS nh FROM p WINDOW w AS (PARTITION BY query_id, head))
SELECT query_id, global_id, round(CASE WHEN head THEN 0.75 * CASE WHEN sh - sl < 1e-12 THEN score ELSE (score - sl) / (sh - sl) END + 0.25 * CASE WHEN nh - nl < 1e-12 THEN near ELSE (near - nl) / (nh - nl) END ELSE score END, 6) AS score FROM m""")
def context_boost(t):
    scores = fusion.weighted_sum(t.signals, W)
    # a query's similarity is asked of its candidates and the frames after them only
    near = scores.select("query_id", F.explode(t.following(F.col("global_id"), 12)).alias("global_id")).distinct()
    ctx = near.join(t.lane32.select("global_id", "v"), "global_id").join(t.queries(t.lane32), "query_id").select("query_id", "global_id", dot(F.col("qv"), F.col("v")).alias("sim"))
    return rounded(fusion.context_boost(scores, t.with_video(ctx))).select("query_id", "global_id", "score")


@query("cross_rerank", """
WITH m AS (SELECT query_id, global_id, rank, score, global_id % 13 / 13.0::DOUBLE AS c FROM top64), n AS (SELECT *, min(score) OVER w AS sl, max(score) OVER w AS sh, min(c) OVER w AS cl, max(c) OVER w AS ch FROM m WHERE rank <= 60 WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, global_id, rank, round(0.5 * (score - sl) / (sh - sl) + 0.5 * (c - cl) / (ch - cl), 9) AS blend FROM n)
SELECT query_id, global_id, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, rank) AS new_rank FROM b UNION ALL SELECT query_id, global_id, rank FROM m WHERE rank > 60""")
def cross_rerank(t):
    top = t.lane_top("visual")
    cross = top.select("query_id", "global_id", (F.col("global_id") % 13 / 13.0).alias("cross"))
    return rerank.cross_rerank(top, cross, 60).select("query_id", "global_id", "new_rank")


@query("vlm_rerank", """
WITH b AS (SELECT query_id, global_id, rank, (global_id % 11 + global_id % 7) / 2.0::DOUBLE AS vote FROM top64)
SELECT query_id, global_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 24 THEN 0 ELSE 1 END, CASE WHEN rank <= 24 THEN -vote ELSE 0 END, rank) AS new_rank FROM b""")
def vlm_rerank(t):
    top = t.lane_top("visual")
    ballots = top.select("query_id", "global_id", F.explode(F.array((F.col("global_id") % 11).cast("double"), (F.col("global_id") % 7).cast("double"))).alias("vote"))
    return rerank.ballot_rerank(top, ballots).select("query_id", "global_id", "new_rank")


@query("low_confidence_retry", f"""
WITH {_MARGIN}, weak AS (SELECT query_id FROM margin WHERE margin < 0.68), s AS (SELECT query_id, 'p' AS signal, global_id, score, rank FROM top64 UNION ALL SELECT query_id, 'v', global_id, score, rank FROM top32),
f AS (SELECT query_id, global_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM s JOIN weak USING (query_id) GROUP BY ALL)
SELECT query_id, rank, global_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) AS rank FROM f) WHERE rank <= 100
UNION ALL SELECT query_id, rank, global_id FROM top64 WHERE query_id NOT IN (SELECT query_id FROM weak)""")
def low_confidence_retry(t):
    keep = ["query_id", "signal", "global_id", "score"]
    return rerank.retry_low_confidence(t.lane_top("visual").select(*keep), t.lane_top("alt").select(*keep), evaluate.confidence_margin(t.run("a")), 0.68)


@query("kis_multi_event", """
WITH s AS (SELECT query_id, global_id, rank FROM top64 UNION ALL SELECT query_id, global_id + 1, rank FROM top32 WHERE rank <= 24 AND global_id % 20 < 19)
SELECT query_id, rank, global_id FROM (SELECT query_id, global_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, global_id) AS rank FROM s GROUP BY query_id, global_id) WHERE rank <= 100""")
def kis_multi_event(t):
    """A single-text ranking fused with the frames of event chains."""
    single = t.lane_top("visual").select("query_id", "signal", "global_id", "score")
    frames = t.lane_top("alt", 24).where("global_id % 20 < 19").select("query_id", F.lit("chain").alias("signal"), (F.col("global_id") + 1).alias("global_id"), (-F.col("rank")).cast("double").alias("score"))
    placed = fusion.ranked(single, ["query_id", "signal"]).select("query_id", "global_id", "rank").unionByName(frames.select("query_id", "global_id", (-F.col("score")).cast("int").alias("rank")))
    fused = placed.groupBy("query_id", "global_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    return fusion.top_k(fused, 100, ["query_id"]).select("query_id", "rank", "global_id")


@query("pairwise_losses", """
WITH p AS (SELECT a.global_id // 32 AS batch, a.global_id AS i, b.global_id AS j, list_dot_product(a.v, list_transform(range(1, 65), lambda k: b.v[k] + 0.1)) AS s FROM vectors a JOIN vectors b ON a.global_id // 32 = b.global_id // 32),
w AS (SELECT *, ln(sum(exp(10 * s)) OVER (PARTITION BY i)) - 10 * s AS lr, ln(sum(exp(10 * s)) OVER (PARTITION BY j)) - 10 * s AS lc FROM p)
SELECT batch, round(sum(ln(1 + exp(-CASE WHEN i = j THEN 1 ELSE -1 END * (10 * s - 5)))) / count(*) FILTER (i = j), 6) AS sigmoid, round(sum((lr + lc) / 2) FILTER (i = j) / count(*) FILTER (i = j), 6) AS contrastive, round(sum(1 - s) FILTER (i = j) / count(*) FILTER (i = j), 6) AS distill FROM w GROUP BY batch""")
def pairwise_losses(t):
    v = t.vectors.withColumn("batch", F.floor(F.col("global_id") / 32))  # every row, in batches of 32
    a = v.select("batch", F.col("global_id").alias("i"), F.col("v").alias("a"))
    b = v.select("batch", F.col("global_id").alias("j"), F.transform("v", lambda x: x + 0.1).alias("b"))
    return rounded(rerank.pairwise_losses(a.join(b, "batch")), "sigmoid", "contrastive", "distill")


@query("wiseft_interpolate", "SELECT global_id, round(0.7 * v[1] + 0.3 * v[2], 6) AS first, round(0.7 * v[64] + 0.3 * v[1], 6) AS last FROM vectors")
def wiseft_interpolate(t):
    turned = F.concat(F.slice("v", 2, 63), F.slice("v", 1, 1))
    mixed = t.vectors.select("global_id", interpolate(F.col("v"), turned, 0.3).alias("w"))
    return mixed.select("global_id", F.round(F.get("w", F.lit(0)), 6).alias("first"), F.round(F.get("w", F.lit(63)), 6).alias("last"))
