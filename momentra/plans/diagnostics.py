"""Diagnostics and run comparison as queries (X*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diagnose, evaluate
from .aggregates import _CONF, confidences, rounded
from .base import query


@query("classify_qa", """
WITH a AS (SELECT * FROM run_a WHERE query_id <> 6), q AS (SELECT DISTINCT query_id FROM gt),
m AS (SELECT a.query_id, a.rank, bool_or(g.lo IS NOT NULL) AS same_video, coalesce(bool_or(a.frame_idx BETWEEN g.lo AND g.hi), false) AS moment, coalesce(bool_or(a.frame_idx BETWEEN g.lo AND g.hi AND a.answer = upper(left(g.answers[1], 1)) || substr(g.answers[1], 2)), false) AS exact, coalesce(bool_or(a.frame_idx BETWEEN g.lo AND g.hi AND regexp_replace(lower(a.answer), '[.]+$', '') = g.answers[1]), false) AS norm FROM a LEFT JOIN gt g ON g.query_id = a.query_id AND g.video_id = a.video_id GROUP BY ALL),
s AS (SELECT query_id, bool_or(same_video) AS same_video, bool_or(moment) AS moment, bool_or(norm) AS norm FROM m GROUP BY query_id)
SELECT q.query_id, CASE WHEN s.query_id IS NULL THEN 'NO_SUBMISSION' WHEN s.norm THEN 'OK' WHEN s.moment THEN 'ANSWER_MISS' WHEN s.same_video THEN 'NEAR_MISS' ELSE 'NO_VIDEO' END AS verdict FROM q LEFT JOIN s USING (query_id)""")
def classify_qa(t):
    return diagnose.classify_qa(t.run("a").where("query_id <> 6"), t.ground_truth).select("query_id", "verdict")


@query("diagnose_trake", """
WITH h AS (SELECT a.query_id, min(a.rank) AS first_rank, min(a.rank) FILTER (a.frame_idx BETWEEN g.lo AND g.hi) AS first_hit FROM run_a a JOIN gt g ON g.query_id = a.query_id AND g.video_id = a.video_id GROUP BY a.query_id)
SELECT query_id, first_rank, first_hit, coalesce(first_hit - first_rank, 100) AS headroom FROM h""")
def diagnose_trake(t):
    return diagnose.first_ranks(t.run("a"), t.ground_truth)


@query("build_gt_from_reference", """
WITH first AS (SELECT query_id, video_id AS v FROM run_a WHERE rank = 1)
SELECT a.query_id, a.rank AS event_idx, a.video_id, a.frame_idx - 125 AS lo, a.frame_idx + 125 AS hi, a.answer FROM run_a a JOIN first f ON f.query_id = a.query_id AND f.v = a.video_id WHERE a.rank <= 5""")
def build_gt_from_reference(t):
    return diagnose.ground_truth_from(t.run("a"), 125)


_DIFF = "SELECT coalesce(a.query_id, b.query_id) AS query_id FROM (SELECT * FROM run_a WHERE rank = 1) a FULL JOIN (SELECT * FROM run_b WHERE rank = 1 AND query_id <> 5) b ON a.query_id = b.query_id WHERE a.video_id IS DISTINCT FROM b.video_id OR a.frame_idx IS DISTINCT FROM b.frame_idx"


@query("diff_top1", _DIFF)
def diff_top1(t):
    return evaluate.top1_diff(t.run("a"), t.run("b").where("query_id <> 5")).where("status <> 'same'").select("query_id")


@query("build_plan", f"""
WITH {_CONF}, e AS (SELECT DISTINCT query_id FROM gt UNION SELECT 99), c AS (SELECT e.query_id, coalesce(conf.confidence, 0) AS confidence FROM e LEFT JOIN conf USING (query_id)),
r AS (SELECT *, row_number() OVER (ORDER BY confidence, query_id) AS p, count(*) OVER () AS n FROM c)
SELECT query_id, confidence, confidence < 0.35 AND p <= ceil(0.5 * n) AS weak FROM r""")
def build_plan(t):
    stems = t.ground_truth.select("query_id").union(t.spark.createDataFrame([(99,)], "query_id long")).distinct()
    every = stems.join(confidences(t), "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    weak = evaluate.select_weak(every, 0.35, 0.5).select("query_id", F.lit(True).alias("weak"))
    return every.join(weak, "query_id", "left").select("query_id", "confidence", F.coalesce("weak", F.lit(False)).alias("weak"))


@query("latency_bench", """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, round(v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INTEGER) + 1], 6) AS p50, round(v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1], 6) AS p95, round(v[CAST(round_even(0.99 * (len(v) - 1), 0) AS INTEGER) + 1], 6) AS p99 FROM s""")
def latency_bench(t):
    return rounded(diagnose.nearest_rank(t.raw("events"), "event_type", "value"), "p50", "p95", "p99")


@query("ablation_battery", """
WITH g AS (SELECT * FROM (VALUES ('full', 0.6, 0.4), ('no alt', 0.6, 0.0), ('no visual', 0.0, 0.4)) AS v(name, wv, wa)),
f AS (SELECT name, query_id, global_id, round(sum(score * CASE signal WHEN 'visual' THEN wv WHEN 'alt' THEN wa ELSE 0.25 END), 9) AS s FROM normed, g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name, query_id ORDER BY s DESC, global_id) AS rank FROM f)
SELECT name, query_id, min(rank) FILTER (global_id % 50 = query_id) AS first_hit FROM r GROUP BY ALL""")
def ablation_battery(t):
    from ..operators.fusion import normalized

    g = t.spark.createDataFrame([("full", 0.6, 0.4), ("no alt", 0.6, 0.0), ("no visual", 0.0, 0.4)], "name string, wv double, wa double")
    w = F.when(F.col("signal") == "visual", F.col("wv")).when(F.col("signal") == "alt", F.col("wa")).otherwise(0.25)
    f = normalized(t.signals).join(F.broadcast(g)).groupBy("name", "query_id", "global_id").agg(F.round(F.sum(F.col("score") * w), 9).alias("s"))
    r = f.withColumn("rank", F.row_number().over(Window.partitionBy("name", "query_id").orderBy(F.desc("s"), "global_id")))
    return r.groupBy("name", "query_id").agg(F.min(F.when(F.col("global_id") % 50 == F.col("query_id"), F.col("rank"))).alias("first_hit"))
