"""Extension points and services as queries (Z*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequence
from ..streaming import breaker
from .base import query


@query("table_valued_params", "SELECT c.global_id, g.frame_idx AS grid FROM catalog c JOIN catalog g ON g.video_id = c.video_id AND g.frame_idx = c.frame_idx + 125")
def table_valued_params(t):
    """Function-valued parameters become tables: the grid of a video is a join."""
    grid = t.catalog.select("video_id", F.col("frame_idx").alias("grid"), (F.col("frame_idx") - 125).alias("frame_idx"))
    return t.catalog.join(grid, ["video_id", "frame_idx"]).select("global_id", "grid")


@query("ballot_votes", """
WITH b AS (SELECT conv_id AS group_id, turn AS pos, role AS ballot FROM conversations WHERE trim(role) <> ''), c AS (SELECT group_id, lower(ballot) AS k, count(*) AS votes, min(pos) AS first, arg_min(ballot, pos) AS answer FROM b GROUP BY ALL)
SELECT group_id, answer, votes, total FROM (SELECT *, CAST(sum(votes) OVER (PARTITION BY group_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, first) AS r FROM c) WHERE r = 1""")
def ballot_votes(t):
    ballots = t.raw("conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), F.col("role").alias("ballot"))
    return sequence.majority_vote(ballots, F.lower("ballot"))


@query("circuit_breaker", """
WITH o AS (SELECT user_id AS model, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type IN ('error', 'click') AS failed FROM events),
i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY n) AS island FROM o),
r AS (SELECT *, sum(CAST(failed AS INT)) OVER (PARTITION BY model, island ORDER BY n) AS run, count(*) OVER l AS seen, sum(CAST(failed AS INT)) OVER l AS bad FROM i WINDOW l AS (PARTITION BY model ORDER BY n ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT model, n, failed AND (run >= 3 OR (seen = 8 AND bad >= 6)) AS opens FROM r""")
def circuit_breaker(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    o = t.raw("events").select(F.col("user_id").alias("model"), n.alias("n"), F.col("event_type").isin("error", "click").alias("failed"))
    return breaker.openings(o)


@query("run_ingest", "SELECT video_id, count(*) AS frames FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM catalog d WHERE d.video_id = c.video_id AND d.label = 3 AND d.n <= 4) GROUP BY video_id")
def run_ingest(t):
    """Incremental step: only videos that no earlier output holds."""
    done = t.catalog.where("label = 3 and n <= 4").select("video_id")
    return t.catalog.join(done, "video_id", "left_anti").groupBy("video_id").agg(F.count("*").alias("frames"))


@query("encode_provider")
def encode_provider(t):
    """Texts through the embedding seam, with the local hashing encoder as provider."""
    from ..sources import local_models, providers

    return providers.encode(t.raw("benchmark").select("item_id", "text"), local_models.HashingEncoder).select("item_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("embedding_provider_api")
def embedding_provider_api(t):
    """Text search with provider vectors: nearest other texts."""
    from ..functions.vectors import dot
    from ..operators.fusion import top_k
    from ..sources import local_models, providers

    v = providers.encode(t.raw("benchmark").select("item_id", "text"), local_models.HashingEncoder)
    q = v.select(F.col("item_id").alias("query_id"), F.col("v").alias("qv"))
    s = v.join(q).where("item_id <> query_id").select("query_id", F.col("item_id").alias("global_id"), F.round(dot(F.col("v"), F.col("qv")), 6).alias("score"))
    return top_k(s, 5, ["query_id"])


@query("reranker_provider_api")
def reranker_provider_api(t):
    """Pairs through the reranking seam, with token overlap as provider."""
    from ..sources import local_models, providers

    b = t.raw("benchmark")
    pairs = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")).join(b)
    return providers.rerank_scores(pairs, local_models.OverlapReranker, "q", "text").select("query_id", "item_id", F.round("cross", 6).alias("score"))


@query("dhash", """
SELECT a.global_id, CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN p[i // 8 * 9 + i % 8 + 2] > p[i // 8 * 9 + i % 8 + 1] THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE 0 END)) + CASE WHEN p[72] > p[71] THEN 1 ELSE 0 END - CASE WHEN p[2] > p[1] THEN CAST(1 AS HUGEINT) << 64 ELSE 0 END AS BIGINT) AS dhash
FROM (SELECT global_id, list_concat(v, v[1:8]) AS p FROM vectors) a""")
def dhash(t):
    """Difference hashes of 9 x 8 'images', here the first 72 cyclic components of each vector."""
    from ..sources import providers

    return providers.difference_hash(t.vectors.select("global_id", F.concat("v", F.slice("v", 1, 8)).alias("gray"))).select("global_id", "dhash")


@query("rebuild_map")
def rebuild_map(t):
    from ..operators import alignment

    h = F.conv(F.substring(F.md5(F.concat_ws(":", "video_id", "frame_idx")), 1, 15), 16, 10).cast("long").alias("h")
    frames = t.catalog.select("video_id", F.explode(F.sequence((F.col("n") - 1) * 5, F.col("n") * 5 - 1)).alias("frame_idx"))
    stream = frames.select("video_id", "frame_idx", h)
    keys = stream.where("frame_idx % 20 = 8").select("video_id", F.floor(F.col("frame_idx") / 20).cast("int").alias("hash_no"), "h")
    return alignment.rebuild_map(keys, stream, 5)


@query("run_auto", """
WITH f AS (SELECT item_id, 'query-' || lpad(CAST(item_id AS VARCHAR), 4, '0') || ['-kis', '-qa', '-trake'][item_id % 3 + 1] AS name FROM benchmark WHERE item_id % 5 <> 0),
k AS (SELECT name, CASE WHEN contains(name, 'trake') THEN 'trake' WHEN contains(name, 'qa') THEN 'qa' ELSE 'kis' END AS task FROM f)
SELECT name, task, row_number() OVER (ORDER BY CASE task WHEN 'kis' THEN 0 WHEN 'trake' THEN 1 ELSE 2 END, name) AS pos, greatest(5, (60 - 25) * 0.45) < row_number() OVER (ORDER BY CASE task WHEN 'kis' THEN 0 WHEN 'trake' THEN 1 ELSE 2 END, name) * 5 AS sprint FROM k""")
def run_auto(t):
    from ..operators import batch

    kinds = F.array(*map(F.lit, ("-kis", "-qa", "-trake")))
    name = F.concat(F.lit("query-"), F.lpad(F.col("item_id").cast("string"), 4, "0"), F.get(kinds, (F.col("item_id") % 3).cast("int")))
    pack = t.raw("benchmark").select("item_id", name.alias("name"))
    finished = pack.select("name", F.lit(10).alias("n_rows"), F.when(F.col("item_id") % 5 == 0, 0).otherwise(1).alias("n_issues"))
    return batch.plan(pack.select("name"), finished, F.lit(60))


@query("http_service")
def http_service(t):
    """The service surface as a plan: a text-vector search with boosts, as a client would get it."""
    from ..api import Engine

    return Engine(t.spark, t.folder).search(t.queries(t.vectors), 20).select("query_id", "rank", "global_id", "video_id", F.round("score", 6).alias("score"))
