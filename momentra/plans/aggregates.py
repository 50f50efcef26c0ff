"""Aggregations as queries (A*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bm25, evaluate, fusion, objects, rows, sequence
from .base import query
from .scans import _BOTH, both_runs

W = {"visual": 0.6, "alt": 0.4, "object": 0.25}


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names or ("score",)})


@query("video_span", "SELECT video_id, min(global_id) AS first_gid, count(*) AS n FROM catalog GROUP BY video_id")
def video_span(t):
    return t.catalog.groupBy("video_id").agg(F.min("global_id").alias("first_gid"), F.count("*").alias("n"))


@query("corpus_signature", "SELECT substr(sha256(string_agg(video_id || ':' || n, ';' ORDER BY video_id)), 1, 16) AS signature FROM (SELECT video_id, count(*) AS n FROM catalog GROUP BY video_id)")
def corpus_signature(t):
    counts = t.catalog.groupBy("video_id").agg(F.count("*").alias("n"))  # one row a video
    body = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "video_id", "n"))), ";")
    return counts.agg(F.substring(F.sha2(body, 256), 1, 16).alias("signature"))


@query("bm25_build", "SELECT token, df, n_docs, round(avgdl, 6) AS avgdl FROM df, corpus")
def bm25_build(t):
    df, totals = bm25.statistics(bm25.postings(t.text_docs))
    return rounded(df.join(F.broadcast(totals)), "avgdl")


@query("bm25_score", "SELECT query_id, key, round(score, 6) AS score FROM bm25")
def bm25_score(t):
    return rounded(bm25.score(t.text_docs, t.asked_texts))


@query("bm25_persisted", "SELECT query_id, key, round(score, 6) AS score FROM bm25")
def bm25_persisted(t):
    """The same scores from the postings and statistics of the index on disk."""
    return rounded(t.text_index().score(t.asked_texts))


@query("bm25_inmemory", "SELECT query_id, key // 4 AS key, round(max(score), 6) AS score FROM bm25 GROUP BY ALL")
def bm25_inmemory(t):
    """Keys that own several documents: the best document counts."""
    docs = t.text_docs.select(F.floor(F.col("key") / 4).alias("key"), F.col("key").alias("doc_no"), "text")
    return rounded(bm25.score(docs, t.asked_texts))


@query("aggregate_queries_max", "SELECT query_id, global_id, round(max(score), 6) AS score FROM signals GROUP BY ALL")
def aggregate_queries_max(t):
    return rounded(fusion.aggregate_variants(t.signals))


@query("aggregate_queries_mean", "SELECT query_id, global_id, round(avg(score), 6) AS score FROM signals GROUP BY ALL")
def aggregate_queries_mean(t):
    return rounded(fusion.aggregate_variants(t.signals, mean=True))


@query("weighted_sum", "SELECT query_id, global_id, round(score, 6) AS score FROM fused")
def weighted_sum(t):
    return rounded(fusion.weighted_sum(t.signals, W))


@query("minmax", "SELECT query_id, signal, global_id, round(score, 6) AS score FROM normed")
def minmax(t):
    return rounded(fusion.normalized(t.signals))


_RRF = "rr AS (SELECT query_id, global_id, sum(1.0 / (60 + r)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, global_id) AS r FROM signals) GROUP BY ALL)"


@query("rrf", f"WITH {_RRF} SELECT query_id, global_id, round(score, 6) AS score FROM rr")
def rrf(t):
    return rounded(fusion.rrf(t.signals))


@query("rrf_merge_runs", """
WITH u AS (SELECT 'a' AS run, * FROM run_a UNION ALL SELECT 'b', * FROM run_b),
m AS (SELECT query_id, video_id, frame_idx, sum(CASE run WHEN 'a' THEN 1.0 ELSE 0.5 END / (60 + rank)) AS score, min((run, rank)) AS seen, arg_min(answer, (rank, run)) AS answer FROM u GROUP BY ALL)
SELECT query_id, rank, video_id, frame_idx, answer, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM m) WHERE rank <= 100""")
def rrf_merge_runs(t):
    runs = t.run("a").withColumn("run", F.lit("a")).unionByName(t.run("b").withColumn("run", F.lit("b")))
    return rounded(rows.merge_runs(runs, {"a": 1.0, "b": 0.5})).select("query_id", "rank", "video_id", "frame_idx", "answer", "score")


@query("pool_videos", """
WITH e AS (SELECT CAST(query_id // 2 AS BIGINT) AS q, query_id % 2 AS ev, c.video_id, score FROM top64 JOIN catalog c USING (global_id)),
b AS (SELECT q, video_id, ev, greatest(0, max(score)) AS s FROM e GROUP BY ALL)
SELECT q AS query_id, video_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, video_id) AS rank FROM (SELECT q, video_id, sum(s) AS score FROM b GROUP BY ALL)) WHERE rank <= 10""")
def pool_videos(t):
    e = t.with_video(t.lane_top("visual")).select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("event_idx"), "video_id", "score")
    return rounded(sequence.pool_videos(e, 10))


@query("majority_vote", """
WITH b AS (SELECT query_id AS group_id, rank AS pos, answer AS ballot, lower(trim(answer)) AS k FROM run_a WHERE rank <= 15 AND trim(answer) <> ''),
c AS (SELECT group_id, k, count(*) AS votes, min(pos) AS first, arg_min(ballot, pos) AS ballot FROM b GROUP BY ALL)
SELECT group_id, answer, votes, total FROM (SELECT group_id, ballot AS answer, votes, CAST(sum(votes) OVER (PARTITION BY group_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, first) AS r FROM c) WHERE r = 1""")
def majority_vote(t):
    ballots = t.run("a").where("rank <= 15").select(F.col("query_id").alias("group_id"), F.col("rank").alias("pos"), F.col("answer").alias("ballot"))
    return sequence.majority_vote(ballots, F.lower(F.trim("ballot")))


_MARGIN = "margin AS (SELECT query_id, CASE WHEN count(*) < 10 THEN 0 ELSE greatest(0, least(1, (max(score) FILTER (rank = 1) - max(score) FILTER (rank = n // 2 + 1)) / (abs(max(score) FILTER (rank = 1)) + 1e-12))) END AS margin FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM run_a) GROUP BY query_id)"
_SHARE = "share AS (SELECT query_id, avg(CASE WHEN video_id = v1 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT *, first_value(video_id) OVER (PARTITION BY query_id ORDER BY rank) AS v1 FROM run_a) WHERE rank <= 10 GROUP BY query_id)"
_AGREE = "agree AS (SELECT query_id, max(c) / sum(c) AS agree FROM (SELECT query_id, regexp_replace(lower(trim(answer)), '[.]+$', '') AS k, count(*)::DOUBLE AS c FROM run_a WHERE rank <= 30 GROUP BY ALL) GROUP BY query_id)"


@query("ranking_confidence", f"WITH {_MARGIN} SELECT query_id, round(margin, 6) AS margin FROM margin")
def ranking_confidence(t):
    return rounded(evaluate.confidence_margin(t.run("a")), "margin")


@query("video_concentration", f"WITH {_SHARE} SELECT query_id, round(share, 6) AS share FROM share")
def video_concentration(t):
    return rounded(evaluate.video_share(t.run("a")), "share")


@query("answer_consensus", f"WITH {_AGREE} SELECT query_id, round(agree, 6) AS agree FROM agree")
def answer_consensus(t):
    return rounded(evaluate.consensus(t.run("a"), sequence.is_non_answer(F.col("answer"))), "agree")


_CONF = f"{_MARGIN}, {_SHARE}, {_AGREE}, conf AS (SELECT query_id, round((margin * 0.5 + share * 0.3 + coalesce(CASE WHEN query_id % 2 = 0 THEN agree END * 0.2, 0)) / (0.8 + CASE WHEN query_id % 2 = 0 THEN 0.2 ELSE 0 END), 6) AS confidence FROM margin JOIN share USING (query_id) JOIN agree USING (query_id))"


def confidences(t):
    a = t.run("a")
    agree = evaluate.consensus(a, sequence.is_non_answer(F.col("answer"))).withColumn("agree", F.when(F.col("query_id") % 2 == 0, F.col("agree")))
    parts = evaluate.confidence_margin(a).join(evaluate.video_share(a), "query_id").join(agree, "query_id")
    return evaluate.combined_confidence(parts).select("query_id", "confidence")


@query("query_confidence", f"WITH {_CONF} SELECT query_id, confidence FROM conf")
def query_confidence(t):
    return confidences(t)


_R = "scored AS (SELECT a.query_id, a.rank, CASE WHEN bool_or(g.lo IS NOT NULL) THEN 1.0 ELSE 0.0 END AS r FROM run_a a LEFT JOIN gt g ON g.query_id = a.query_id AND g.video_id = a.video_id AND a.frame_idx BETWEEN g.lo AND g.hi GROUP BY ALL)"
_RK = f"{_R}, rk AS (SELECT query_id, max(r) FILTER (rank <= 1) AS r_1, max(r) FILTER (rank <= 5) AS r_5, max(r) FILTER (rank <= 20) AS r_20, max(r) FILTER (rank <= 50) AS r_50, max(r) FILTER (rank <= 100) AS r_100 FROM scored GROUP BY query_id)"
_FINAL = f"{_RK}, fin AS (SELECT *, (r_1 + r_5 + r_20 + r_50 + r_100) / 5 AS final FROM rk)"


def scored(t, run="a"):
    return evaluate.hits(t.run(run), t.ground_truth).select("query_id", "rank", F.col("hit").cast("double").alias("r"))


@query("r_at_k", f"WITH {_FINAL} SELECT query_id, r_1, r_5, r_20, r_50, r_100, round(final, 6) AS final FROM fin")
def r_at_k(t):
    return rounded(evaluate.r_at_k(scored(t)), "final")


@query("qualifier_score", f"WITH {_R} SELECT query_id, CASE WHEN f = 1 THEN 1.0 WHEN f <= 5 THEN 0.8 WHEN f <= 20 THEN 0.6 WHEN f <= 50 THEN 0.4 WHEN f <= 100 THEN 0.2 ELSE 0.0 END AS score FROM (SELECT query_id, min(rank) FILTER (r > 0) AS f FROM scored GROUP BY query_id)")
def qualifier_score(t):
    first = scored(t).groupBy("query_id").agg(F.min(F.when(F.col("r") > 0, F.col("rank"))).alias("f"))
    return first.select("query_id", evaluate.qualifier(F.col("f")).alias("score"))


@query("score_run", f"""
WITH {_FINAL}, entries AS (SELECT DISTINCT query_id, CASE WHEN query_id % 3 = 0 THEN 'qa' ELSE 'kis' END AS task FROM gt), j AS (SELECT e.*, CASE WHEN e.query_id <> 4 THEN final END AS final FROM entries e LEFT JOIN fin USING (query_id))
SELECT coalesce(task, 'all') AS task, count(*) AS n, count(final) AS scored, round(sum(coalesce(final, 0)), 6) AS sum_final, round(sum(coalesce(final, 0)) / count(*), 6) AS mean_final FROM j GROUP BY CUBE (task)""")
def score_run(t):
    entries = t.ground_truth.select("query_id", F.when(F.col("query_id") % 3 == 0, "qa").otherwise("kis").alias("task")).distinct()
    return rounded(evaluate.report(evaluate.r_at_k(scored(t)).where("query_id <> 4"), entries), "sum_final", "mean_final")


@query("coverage_at_k", """
WITH f AS (SELECT g.query_id, g.event_idx, min(a.rank) FILTER (a.frame_idx BETWEEN g.lo AND g.hi) AS first FROM gt g LEFT JOIN run_a a ON a.query_id = g.query_id AND a.video_id = g.video_id GROUP BY ALL)
SELECT query_id, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS c_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS c_5, round(avg(CASE WHEN first <= 20 THEN 1.0 ELSE 0 END), 6) AS c_20, round(avg(CASE WHEN first <= 50 THEN 1.0 ELSE 0 END), 6) AS c_50, round(avg(CASE WHEN first <= 100 THEN 1.0 ELSE 0 END), 6) AS c_100 FROM f GROUP BY query_id""")
def coverage_at_k(t):
    return rounded(evaluate.coverage(t.run("a"), t.ground_truth), *[f"c_{k}" for k in evaluate.KS])


@query("retrieval_metrics", """
WITH target AS (SELECT query_id, max(score) AS ts FROM s64 WHERE global_id = query_id * 37 + 11 GROUP BY query_id),
r AS (SELECT query_id, 1 + count(*) FILTER (score > ts) AS rank FROM s64 JOIN target USING (query_id) GROUP BY query_id)
SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, round(avg(1.0 / rank), 6) AS mrr, median(rank)::DOUBLE AS medr FROM r""")
def retrieval_metrics(t):
    s = t.lane_scores(t.vectors)
    target = s.where(F.col("global_id") == F.col("query_id") * 37 + 11).select("query_id", F.col("score").alias("ts"))
    r = s.join(F.broadcast(target), "query_id").groupBy("query_id").agg((1 + F.count_if(F.col("score") > F.col("ts"))).alias("rank"))
    return r.agg(*[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"r{k}") for k in (1, 5, 10)], F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.median("rank").alias("medr"))


@query("concept_counts", """
WITH c AS (SELECT t.query_id, d.entity, count(*) AS n FROM detections d JOIN top64 t ON t.global_id = d.frame AND t.rank <= 30 WHERE d.score >= 0.4 GROUP BY ALL)
SELECT query_id, entity, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, entity) AS rank FROM c) WHERE rank <= 10""")
def concept_counts(t):
    top = t.lane_top("visual", 30).select("query_id", F.col("global_id").alias("frame"))
    return objects.concept_counts(t.detections, top)


@query("doctor_coverage", "SELECT count(DISTINCT video_id) AS videos, count(DISTINCT CASE WHEN has_map THEN video_id END) AS with_map, count(DISTINCT CASE WHEN label = 3 THEN video_id END) AS with_label, bool_or(has_map) AS any_map FROM catalog")
def doctor_coverage(t):
    per = t.catalog.groupBy("video_id").agg(F.bool_or("has_map").alias("m"), F.bool_or(F.col("label") == 3).alias("l"))
    return per.agg(F.count("*").alias("videos"), F.count_if("m").alias("with_map"), F.count_if("l").alias("with_label"), F.bool_or("m").alias("any_map"))


_FINAL_B = _FINAL.replace("run_a", "run_b").replace("scored", "scored_b").replace("rk AS", "rk_b AS").replace("FROM rk)", "FROM rk_b)").replace("fin AS", "fin_b AS")


@query("diff_counts", f"""
WITH {_FINAL}, {_FINAL_B}, j AS (SELECT a.final AS x, b.final AS y FROM (SELECT * FROM fin WHERE query_id <> 1) a FULL JOIN (SELECT * FROM fin_b WHERE query_id <> 5) b ON a.query_id = b.query_id)
SELECT count(*) FILTER (y - x > 1e-9) AS improved, count(*) FILTER (y - x < -1e-9) AS worsened, count(*) FILTER (abs(y - x) <= 1e-9) AS unchanged, count(*) FILTER (x IS NULL) AS new, count(*) FILTER (y IS NULL) AS gone FROM j""")
def diff_counts(t):
    a, b = (evaluate.r_at_k(scored(t, run)) for run in "ab")
    return evaluate.diff_counts(a.where("query_id <> 1"), b.where("query_id <> 5"))


@query("tune_weights", """
WITH grid AS (SELECT a * 5 + b AS trial, a / 4.0::DOUBLE AS wv, b / 4.0::DOUBLE AS wa FROM range(0, 5) AS x(a), range(0, 5) AS y(b)),
f AS (SELECT trial, query_id, global_id, sum(score * CASE signal WHEN 'visual' THEN wv WHEN 'alt' THEN wa ELSE 0.25 END) AS s FROM normed, grid GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY trial, query_id ORDER BY round(s, 9) DESC, global_id) AS rank FROM f),
h AS (SELECT trial, query_id, min(rank) FILTER (global_id % 50 = query_id) AS first FROM r GROUP BY ALL)
SELECT trial, round(avg(CASE WHEN first = 1 THEN 1.0 WHEN first <= 5 THEN 0.8 WHEN first <= 20 THEN 0.6 WHEN first <= 50 THEN 0.4 WHEN first <= 100 THEN 0.2 ELSE 0 END), 6) AS score FROM h GROUP BY trial""")
def tune_weights(t):
    """Every weight vector of a grid in one plan: the maps are dealt by query once, and only then multiplied by the trials."""
    grid = t.spark.range(25).select(F.col("id").alias("trial"), (F.floor(F.col("id") / 5) / 4.0).alias("wv"), (F.col("id") % 5 / 4.0).alias("wa"))
    own = [F.coalesce(F.sum(F.when(F.col("signal") == name, F.col("score"))), F.lit(0.0)).alias(name) for name in ("visual", "alt", "object")]
    each = fusion.normalized(t.signals.repartition("query_id")).groupBy("query_id", "global_id").agg(*own)
    fused = each.join(F.broadcast(grid)).withColumn("s", F.col("visual") * F.col("wv") + F.col("alt") * F.col("wa") + F.col("object") * 0.25)
    placed = fused.withColumn("rank", F.row_number().over(Window.partitionBy("trial", "query_id").orderBy(F.round("s", 9).desc(), "global_id")))
    first = placed.groupBy("trial", "query_id").agg(F.min(F.when(F.col("global_id") % 50 == F.col("query_id"), F.col("rank"))).alias("first"))
    return first.groupBy("trial").agg(F.round(F.avg(evaluate.qualifier(F.col("first"))), 6).alias("score"))


@query("pct_fallback_stats", f"""
WITH {_BOTH} SELECT query_id, round(avg(CASE WHEN rank % 4 = 0 THEN 1.0 ELSE 0 END), 6) AS fallback, round(avg(CASE WHEN rank % 4 <> 0 AND answer LIKE '%.' THEN 1.0 ELSE 0 END), 6) AS decorated, 0.0 AS at_cap FROM both_runs GROUP BY query_id""")
def pct_fallback_stats(t):
    a = both_runs(t).withColumn("answer", F.when(F.col("rank") % 4 == 0, "không rõ").otherwise(F.col("answer")))
    no = sequence.is_non_answer(F.col("answer"))
    return a.groupBy("query_id").agg(F.round(F.avg(no.cast("double")), 6).alias("fallback"), F.round(F.avg((~no & F.col("answer").rlike(r"[.\s]$")).cast("double")), 6).alias("decorated"), F.avg((F.length("answer") >= 100).cast("double")).alias("at_cap"))
