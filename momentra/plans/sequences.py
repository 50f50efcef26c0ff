"""Sequence alignment as queries (Q*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, sequence
from .aggregates import rounded
from .base import query
from .scans import _CHAINS, chains

_SIMS = "sims AS (SELECT 0 AS query_id, video_id, n, hours AS time, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS e, least(1, value / 100) AS sim FROM tracks WHERE event_type IN ('signup', 'view', 'click'))"


def sims(t):
    """Event similarities on irregular timelines: three event kinds, hours as time."""
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return t.tracks.where("event_type in ('signup', 'view', 'click')").select(F.lit(0).cast("long").alias("query_id"), "video_id", "n", F.col("hours").alias("time"), kind.alias("event_idx"), F.least(F.lit(1.0), F.col("value") / 100).alias("sim"))


_DANTE = f"""{_SIMS}, ok AS (SELECT * FROM sims WHERE sim >= 0.1), f0 AS (SELECT video_id, n, time, sim AS total, CAST(n AS VARCHAR) AS path FROM ok WHERE e = 0),
f1 AS (SELECT s.video_id, s.n, s.time, arg_max(f.total, (round(f.total + 0.0005 * f.time, 9), f.n)) + s.sim - 0.0005 * (s.time - arg_max(f.time, (round(f.total + 0.0005 * f.time, 9), f.n))) AS total, arg_max(f.path, (round(f.total + 0.0005 * f.time, 9), f.n)) || ',' || s.n AS path FROM ok s JOIN f0 f ON f.video_id = s.video_id AND s.time > f.time AND s.time - f.time <= 72 WHERE s.e = 1 GROUP BY s.video_id, s.n, s.time, s.sim),
f2 AS (SELECT s.video_id, s.n, s.time, arg_max(f.total, (round(f.total + 0.0005 * f.time, 9), f.n)) + s.sim - 0.0005 * (s.time - arg_max(f.time, (round(f.total + 0.0005 * f.time, 9), f.n))) AS total, arg_max(f.path, (round(f.total + 0.0005 * f.time, 9), f.n)) || ',' || s.n AS path FROM ok s JOIN f1 f ON f.video_id = s.video_id AND s.time > f.time AND s.time - f.time <= 72 WHERE s.e = 2 GROUP BY s.video_id, s.n, s.time, s.sim)"""


@query("dante_dp", f"WITH {_DANTE} SELECT video_id, n AS last, round(total / 3, 6) AS score, path AS frames FROM f2")
def dante_dp(t):
    out = sequence.align(sims(t), 3, max_gap=72.0)
    return rounded(out).select("video_id", "last", "score", F.array_join("frames", ",").alias("frames"))


@query("dante_dp_grouped", f"WITH {_DANTE} SELECT video_id, n AS last, round(total / 3, 6) AS score FROM f2")
def dante_dp_grouped(t):
    return rounded(sequence.align_grouped(sims(t), 3, max_gap=72.0)).select("video_id", "last", "score")


@query("beam_dp")
def beam_dp(t):
    return rounded(sequence.beam(sims(t), 3, max_gap=72.0)).select("video_id", "score", F.array_join("frames", ",").alias("frames"))


_MEM = "mem AS (SELECT query_id % 2 AS q, query_id // 2 AS ev, 'a' AS member, c.video_id, c.n, score AS sim FROM top64 JOIN catalog c USING (global_id) UNION ALL SELECT query_id % 2, query_id // 2, 'b', c.video_id, c.n, score FROM top32 JOIN catalog c USING (global_id))"


def members(t):
    both = t.lane_top("visual").withColumn("member", F.lit("a")).unionByName(t.lane_top("alt").withColumn("member", F.lit("b")))
    return both.join(t.catalog.select("global_id", "video_id", "n"), "global_id").select((F.col("query_id") % 2).alias("query_id"), F.floor(F.col("query_id") / 2).alias("event_idx"), "member", "video_id", "n", F.col("score").alias("sim"))


_ENS = f"{_MEM}, sc AS (SELECT *, CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (sim - lo) / (hi - lo) END AS s, CASE member WHEN 'a' THEN 0.6 ELSE 0.4 END AS w FROM (SELECT *, min(sim) OVER v AS lo, max(sim) OVER v AS hi FROM mem WINDOW v AS (PARTITION BY q, member, ev))), ens AS (SELECT q, video_id, n, ev, sum(w * s) / sum(w) AS sim FROM sc GROUP BY ALL)"


@query("pooled_event_hits", f"WITH {_ENS} SELECT q AS query_id, video_id, ev AS event_idx, round(max(w * s), 6) AS score FROM sc GROUP BY ALL")
def pooled_event_hits(t):
    from ..operators.fusion import minmax

    w = F.when(F.col("member") == "a", 0.6).otherwise(0.4)
    m = members(t).withColumn("s", w * minmax(F.col("sim"), Window.partitionBy("query_id", "member", "event_idx"), 0.5))
    return rounded(m.groupBy("query_id", "video_id", "event_idx").agg(F.max("s").alias("score")))


@query("ensemble_video_sims", f"WITH {_ENS} SELECT q AS query_id, video_id, n, ev AS event_idx, round(sim, 6) AS sim FROM ens")
def ensemble_video_sims(t):
    return rounded(sequence.ensemble(members(t), {"a": 0.6, "b": 0.4}), "sim")


@query("reduce_variants", f"WITH {_MEM} SELECT q AS query_id, video_id, n, ev AS event_idx, round(max(sim), 6) AS sim FROM mem GROUP BY ALL")
def reduce_variants(t):
    return rounded(sequence.reduce_variants(members(t)), "sim")


@query("caption_step_signal", f"WITH {_ENS}, cap AS (SELECT q, video_id, n, ev, (n * 7 % 5) / 1.0::DOUBLE AS c FROM ens WHERE n % 2 = 0), cm AS (SELECT *, CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (c - lo) / (hi - lo) END AS s FROM (SELECT *, min(c) OVER v AS lo, max(c) OVER v AS hi FROM cap WINDOW v AS (PARTITION BY q, ev))) SELECT e.q AS query_id, e.video_id, e.n, e.ev AS event_idx, round(sim + 0.3 * coalesce(s, 0), 6) AS sim FROM ens e LEFT JOIN cm ON cm.q = e.q AND cm.video_id = e.video_id AND cm.n = e.n AND cm.ev = e.ev")
def caption_step_signal(t):
    s = sequence.ensemble(members(t), {"a": 0.6, "b": 0.4})
    captions = s.where("n % 2 = 0").select("query_id", "video_id", "n", "event_idx", (F.col("n") * 7 % 5 / 1.0).alias("caption"))
    return rounded(sequence.add_captions(s, captions, 0.3), "sim")


@query("trake_search", f"WITH {_DANTE}, p AS (SELECT video_id, path AS frames, round(total / 3, 9) AS score FROM f2) SELECT row_number() OVER (ORDER BY score DESC, video_id, frames) AS rank, video_id, frames, round(score, 6) AS score FROM p QUALIFY rank <= 50")
def trake_search(t):
    """Alignment over pooled videos, best chains first."""
    best = sequence.align(sims(t), 3, max_gap=72.0).select("video_id", F.array_join("frames", ",").alias("frames"), F.round("score", 9).alias("score"))
    top = best.orderBy(F.desc("score"), "video_id", "frames").limit(50)
    return rounded(top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "video_id", "frames")))).select("rank", "video_id", "frames", "score")


@query("match_hashes_monotonic")
def match_hashes_monotonic(t):
    costs = t.catalog.select("video_id", F.col("n").alias("position"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("hash_no"))
    costs = costs.withColumn("cost", F.abs(F.col("position") - F.col("hash_no") * 5 - 3) + F.col("position") % 3)
    return sequence.match_monotonic(costs, 4)


_INSIDE = "inside AS (SELECT a.query_id, a.video_id, a.frame_idx, a.rank % 3 AS e FROM run_a a)"


@query("grid_ceiling", f"""
WITH {_INSIDE}, c0 AS (SELECT query_id, video_id, frame_idx, e, 1 AS best FROM inside),
two AS (SELECT a.query_id, a.video_id, b.frame_idx, b.e, 2 AS best FROM c0 a JOIN c0 b ON a.query_id = b.query_id AND a.video_id = b.video_id AND a.frame_idx < b.frame_idx AND a.e < b.e),
three AS (SELECT a.query_id, a.video_id, 3 AS best FROM two a JOIN c0 b ON a.query_id = b.query_id AND a.video_id = b.video_id AND a.frame_idx < b.frame_idx AND a.e < b.e)
SELECT query_id, video_id, CAST(max(best) AS BIGINT) AS ceiling FROM (SELECT query_id, video_id, best FROM c0 UNION ALL SELECT query_id, video_id, best FROM two UNION ALL SELECT query_id, video_id, best FROM three) GROUP BY ALL""")
def grid_ceiling(t):
    inside = t.run("a").select("query_id", "video_id", "frame_idx", (F.col("rank") % 3).alias("event_idx"))
    return sequence.grid_ceiling(inside, 3)


@query("r_score_trake", f"""
WITH {_CHAINS}, ev AS (SELECT query_id, event_idx, video_id, lo, hi FROM gt WHERE event_idx < 3), n AS (SELECT query_id, count(*) AS n FROM ev GROUP BY query_id)
SELECT c.query_id, c.rank, round(count(*) FILTER (ev.video_id = c.video_id AND c.frames[ev.event_idx + 1] BETWEEN ev.lo AND ev.hi)::DOUBLE / any_value(n.n), 6) AS r FROM chains c JOIN ev USING (query_id) JOIN n USING (query_id) GROUP BY c.query_id, c.rank""")
def r_score_trake(t):
    return rounded(evaluate.trake_scores(chains(t), t.ground_truth.where("event_idx < 3")), "r")


@query("r_score_qa", """
SELECT a.query_id, a.rank, coalesce(bool_or(a.frame_idx BETWEEN g.lo AND g.hi AND list_contains(g.answers, regexp_replace(lower(a.answer), '[.]+$', ''))), false) AS hit FROM run_a a LEFT JOIN gt g ON g.query_id = a.query_id AND g.video_id = a.video_id GROUP BY a.query_id, a.rank""")
def r_score_qa(t):
    return evaluate.qa_hits(t.run("a"), t.ground_truth).select("query_id", "rank", "hit")


