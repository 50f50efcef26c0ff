"""Window and neighbourhood operators as queries (W*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fusion, greedy, rows, sequence
from .aggregates import W, rounded
from .base import query
from .scans import _CHAINS, chains


def fused(t):
    return t.with_video(fusion.weighted_sum(t.signals, W))


_NEAR = "coalesce(max(greatest(score, 0)) OVER (PARTITION BY query_id, video_id ORDER BY global_id RANGE BETWEEN {a} AND {b}), 0)"
_BOOST = "boosted AS (SELECT query_id, video_id, global_id, score + " + " + ".join(_NEAR.format(a=f"{d} {s}", b=f"{d} {s}") + f" * 0.1 / {d}" for d in (1, 2) for s in ("PRECEDING", "FOLLOWING")) + " AS score FROM {src})"


@query("neighbor_boost", f"WITH {_BOOST.format(src='fusedv')} SELECT query_id, global_id, round(score, 6) AS score FROM boosted")
def neighbor_boost(t):
    return rounded(fusion.neighbor_boost(fused(t)).select("query_id", "global_id", "score"))


_CONSIST = "cons AS (SELECT query_id, video_id, global_id, score + CASE WHEN top > 0 THEN 0.15 * top * ((l1 + r1) / 2 * 0.5 + (l2 + r2) / 2 * 0.25) / top / 0.75 ELSE 0 END AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, {l1} AS l1, {r1} AS r1, {l2} AS l2, {r2} AS r2 FROM fusedv))".format(
    **{f"{s}{d}": _NEAR.format(a=f"{d} {w}", b=f"{d} {w}") for d in (1, 2) for s, w in (("l", "PRECEDING"), ("r", "FOLLOWING"))}
)


@query("neighbor_consistency_boost", f"WITH {_CONSIST} SELECT query_id, global_id, round(score, 6) AS score FROM cons")
def neighbor_consistency_boost(t):
    return rounded(fusion.consistency_boost(fused(t)).select("query_id", "global_id", "score"))


_GROUPS = """grps AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS grp FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, video_id, g) AS best FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR frame_idx - p > 250 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, video_id ORDER BY frame_idx, rank) AS g FROM (
  SELECT query_id, rank, video_id, frame_idx, answer, lag(frame_idx) OVER (PARTITION BY query_id, video_id ORDER BY frame_idx, rank) AS p FROM run_a))))"""


def grouped(t):
    return rows.group_candidates(t.run("a").withColumn("pts_time", F.col("frame_idx") / 25.0))


@query("group_candidates", f"WITH {_GROUPS} SELECT query_id, rank, video_id, frame_idx, grp FROM grps")
def group_candidates(t):
    return grouped(t).select("query_id", "rank", "video_id", "frame_idx", "grp")


def _diversify_sql(source: str) -> str:
    out, src = [], source
    for i, (size, cap) in enumerate(((5, 2), (20, 5))):
        out.append(f"d{i} AS (SELECT query_id, video_id, frame_idx, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ok = 1 AND run <= {size} THEN 0 ELSE 1 END, rank) AS rank FROM (SELECT *, sum(ok) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) <= {cap} THEN 1 ELSE 0 END AS ok FROM {src})))")
        src = f"d{i}"
    return ", ".join(out)


_CLUMPED = "clumped AS (SELECT query_id, video_id, frame_idx, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN hash_v < 3 THEN 0 ELSE 1 END, rank) AS rank FROM (SELECT *, CAST(right(video_id, 1) AS INTEGER) AS hash_v FROM run_a))"


def clumped(t):
    """A ranking whose head is crowded by a few videos."""
    a = t.run("a").withColumn("few", F.right("video_id", F.lit(1)).cast("int") < 3)
    return rows.rerank(a, F.when(F.col("few"), 0).otherwise(1), "rank").select("query_id", "rank", "video_id", "frame_idx")


@query("head_diversify", f"WITH {_CLUMPED}, {_diversify_sql('clumped')} SELECT query_id, rank, video_id, frame_idx FROM d1")
def head_diversify(t):
    return rows.head_diversify(clumped(t)).select("query_id", "rank", "video_id", "frame_idx")


@query("near_dup_suppress")
def near_dup_suppress(t):
    """Per video in order; compared with the last frame kept, so it is sequential."""
    frames = t.catalog.select("global_id", "video_id", "n").join(t.vectors.select("global_id", "v"), "global_id")
    return greedy.suppress_near_dups(frames, 0.2)


@query("median_grid_gap", "SELECT video_id, median(gap)::DOUBLE AS gap FROM (SELECT video_id, frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS gap FROM catalog) WHERE gap IS NOT NULL GROUP BY video_id")
def median_grid_gap(t):
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    return t.catalog.withColumn("gap", F.col("frame_idx") - F.lag("frame_idx").over(w)).where("gap is not null").groupBy("video_id").agg(F.median("gap").alias("gap"))


@query("monotonize", f"""
WITH {_CHAINS} SELECT query_id, rank, CASE WHEN frames[2] < frames[1] OR frames[3] < frames[2] THEN NULL ELSE frames[1] || ',' || greatest(frames[2], frames[1] + 1) || ',' || greatest(frames[3], greatest(frames[2], frames[1] + 1) + 1) END AS frames FROM chains""")
def monotonize(t):
    return chains(t).select("query_id", "rank", F.array_join(sequence.monotonize(F.col("frames")), ",").alias("frames"))


_NEARG = "near AS (SELECT video_id, frame_idx, coalesce((p + frame_idx) // 2, frame_idx) AS e, coalesce((frame_idx + x) // 2, frame_idx) AS l, coalesce(p, frame_idx) AS p, coalesce(x, frame_idx) AS x FROM (SELECT video_id, frame_idx, lag(frame_idx) OVER w AS p, lead(frame_idx) OVER w AS x FROM catalog WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)))"
_PAIRS = "pairs AS (SELECT query_id, rank, video_id, frame_idx AS f1, frame_idx + 250 AS f2 FROM run_a WHERE rank <= 20)"
_JIT = f"""{_NEARG}, {_PAIRS}, opts AS (SELECT query_id, rank, pairs.video_id, f1, f2, unnest([[a.e, b.e], [a.e, f2], [f1, b.e], [a.l, b.l], [a.l, f2], [f1, b.l], [a.p, f2], [f1, b.p], [a.x, f2], [f1, b.x]]) AS fr, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 1) AS o FROM pairs JOIN near a ON a.video_id = pairs.video_id AND a.frame_idx = f1 JOIN near b ON b.video_id = pairs.video_id AND b.frame_idx = f2),
jit AS (SELECT query_id, rank, video_id, fr, row_number() OVER (PARTITION BY query_id, rank ORDER BY o) - 1 AS j FROM (SELECT query_id, rank, video_id, f1, f2, fr, min(o) AS o FROM opts GROUP BY ALL) WHERE fr[1] >= 0 AND fr[1] < fr[2] AND NOT (fr[1] = f1 AND fr[2] = f2))"""


def pairs(t):
    return t.run("a").where("rank <= 20").select("query_id", "rank", "video_id", F.array(F.col("frame_idx"), F.col("frame_idx") + 250).alias("frames"))


@query("jitter_frame_variants", f"WITH {_JIT} SELECT query_id, rank, j, array_to_string(fr, ',') AS frames FROM jit")
def jitter_frame_variants(t):
    return sequence.jitter_variants(pairs(t), t.catalog).select("query_id", "rank", "j", F.array_join("frames", ",").alias("frames"))


@query("expand_jitter", f"""
WITH {_JIT}, best AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS block FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS d FROM pairs WHERE right(video_id, 1) <> '7') WHERE d = 1),
every AS (SELECT query_id, video_id, [f1, f2] AS fr, CASE WHEN rank <= 8 THEN 0 ELSE 2 END AS part, 0 AS block, rank AS o FROM pairs UNION ALL SELECT jit.query_id, video_id, fr, 1, best.block, j FROM jit JOIN best ON best.query_id = jit.query_id AND best.rank = jit.rank AND best.block <= 4),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, block, o, fr) AS r FROM every), firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, fr ORDER BY r) AS d FROM pos)
SELECT query_id, rank, video_id, frames FROM (SELECT query_id, video_id, array_to_string(fr, ',') AS frames, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM firsts WHERE d = 1) WHERE rank <= 100""")
def expand_jitter(t):
    p = pairs(t)
    mapped = t.catalog.select("video_id").distinct().where(F.right("video_id", F.lit(1)) != "7")
    out = sequence.expand_jitter(p, sequence.jitter_variants(p, t.catalog), mapped)
    return out.withColumn("frames", F.array_join("frames", ","))


_VAR = "variants AS (SELECT video_id, frame_idx, j, v FROM (SELECT video_id, frame_idx, unnest([(p + frame_idx) // 2, (frame_idx + x) // 2, p, x]) AS v, unnest([0::BIGINT, 1, 2, 3]) AS j FROM (SELECT video_id, frame_idx, lag(frame_idx) OVER w AS p, lead(frame_idx) OVER w AS x FROM catalog WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx))) WHERE v IS NOT NULL AND v <> frame_idx)"


@query("variant_frames", f"WITH {_VAR} SELECT video_id, frame_idx, j, v AS variant_frame FROM variants")
def variant_frames(t):
    return rows.variant_frames(t.catalog)


@query("diversify_tail", f"""
WITH {_VAR}, anchors AS (SELECT query_id, rank, video_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS d FROM run_a WHERE rank <= 30) WHERE d = 1),
fresh AS (SELECT a.query_id, v.video_id, v.v AS frame_idx, min(v.j * 1000 + a.rank) AS o FROM anchors a JOIN variants v ON v.video_id = a.video_id AND v.frame_idx = a.frame_idx WHERE NOT EXISTS (SELECT 1 FROM run_a b WHERE b.query_id = a.query_id AND b.video_id = v.video_id AND b.frame_idx = v.v) GROUP BY ALL),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS r FROM fresh) WHERE r <= 35),
every AS (SELECT query_id, video_id, frame_idx, CASE WHEN rank <= 30 THEN 0 ELSE 2 END AS b, rank AS o FROM run_a UNION ALL SELECT query_id, video_id, frame_idx, 1, r FROM picked)
SELECT query_id, rank, video_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b, o) AS rank FROM every) WHERE rank <= 100""")
def diversify_tail(t):
    return rows.diversify_tail(t.run("a"), rows.variant_frames(t.catalog)).select("query_id", "rank", "video_id", "frame_idx")


@query("answer_variant_rows", """
WITH fresh AS (SELECT query_id, video_id, frame_idx, replace(answer, 'Label ', '') || '!' AS answer, rank FROM run_a WHERE rank <= 30 AND answer NOT LIKE '%.'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, answer ORDER BY rank) AS d FROM fresh) WHERE d = 1), picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, answer) AS r FROM firsts) WHERE r <= 10),
n AS (SELECT query_id, max(r) AS n FROM picked GROUP BY query_id), every AS (SELECT a.query_id, video_id, frame_idx, answer, 0 AS b, rank AS o FROM run_a a JOIN n USING (query_id) WHERE rank <= 100 - n UNION ALL SELECT query_id, video_id, frame_idx, answer, 1, r FROM picked)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY b, o) AS rank, video_id, frame_idx, answer FROM every""")
def answer_variant_rows(t):
    a = t.run("a")
    variants = a.select("answer").distinct().where("answer not like '%.'").withColumn("variant", F.concat(F.replace("answer", F.lit("Label "), F.lit("")), F.lit("!")))
    return rows.answer_variants_tail(a, variants).select("query_id", "rank", "video_id", "frame_idx", "answer")


@query("qa_hedge_rows", """
WITH other AS (SELECT query_id, video_id, frame_idx, answer || CASE WHEN rank % 2 = 0 THEN '?' ELSE '' END AS answer, rank FROM run_b),
got AS (SELECT a.query_id, a.video_id, a.frame_idx, o.answer, a.rank FROM run_a a JOIN other o USING (query_id, video_id, frame_idx) WHERE a.rank <= 20 AND NOT EXISTS (SELECT 1 FROM run_a s WHERE s.query_id = a.query_id AND s.video_id = a.video_id AND s.frame_idx = a.frame_idx AND lower(s.answer) = lower(o.answer))),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM got) WHERE r <= 10), n AS (SELECT query_id, max(r) AS n FROM picked GROUP BY query_id),
every AS (SELECT a.query_id, video_id, frame_idx, answer, 0 AS b, rank AS o FROM run_a a LEFT JOIN n USING (query_id) WHERE rank <= 100 - coalesce(n, 0) UNION ALL SELECT query_id, video_id, frame_idx, answer, 1, r FROM picked)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY b, o) AS rank, video_id, frame_idx, answer FROM every""")
def qa_hedge_rows(t):
    other = t.run("b").withColumn("answer", F.concat("answer", F.when(F.col("rank") % 2 == 0, "?").otherwise("")))
    return rows.hedge_tail(t.run("a"), other).select("query_id", "rank", "video_id", "frame_idx", "answer")


@query("consistency_rerank", f"""
WITH {_GROUPS}, votes AS (SELECT query_id, grp, min(rank) AS best, count(*) AS n, count(DISTINCT answer) = 1 AND count(*) >= 2 AS unanimous, max(c)::DOUBLE / count(*) AS agree FROM (SELECT *, count(*) OVER (PARTITION BY query_id, grp, answer) AS c FROM grps) GROUP BY ALL),
pick AS (SELECT query_id, min(grp) FILTER (unanimous) AS promoted, max(agree) FILTER (grp = 1) AS top_agree FROM votes GROUP BY query_id)
SELECT g.query_id, row_number() OVER (PARTITION BY g.query_id ORDER BY CASE WHEN p.top_agree < 0.6 AND g.grp = p.promoted THEN 0 ELSE 1 END, g.rank) AS rank, g.video_id, g.frame_idx FROM grps g JOIN pick p USING (query_id)""")
def consistency_rerank(t):
    return greedy.promote_unanimous(grouped(t), 0.6).select("query_id", "rank", "video_id", "frame_idx")


@query("round_robin_extras", f"""
WITH {_GROUPS}, turns AS (SELECT DISTINCT query_id, grp, turn FROM grps, range(1, 4) AS r(turn)), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, grp) AS r FROM turns)
SELECT query_id, grp, count(*) AS extras FROM placed WHERE r <= 20 GROUP BY query_id, grp""")
def round_robin_extras(t):
    return rows.round_robin(grouped(t).select("query_id", "grp").distinct(), 20, 3)


@query("group_strip", f"""
WITH {_GROUPS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY frame_idx, rank) - 1 AS i, count(*) OVER (PARTITION BY query_id, grp) AS n FROM grps),
k AS (SELECT query_id, grp, frame_idx, rank FROM p WHERE n <= 3 OR i IN (0, round_even((n - 1) * 0.5, 0), n - 1))
SELECT query_id, grp, frame_idx, rank FROM k""")
def group_strip(t):
    w = Window.partitionBy("query_id", "grp")
    p = grouped(t).withColumn("i", F.row_number().over(w.orderBy("frame_idx", "rank")) - 1).withColumn("n", F.count("*").over(w))
    picks = F.array(F.lit(0).cast("double"), F.bround((F.col("n") - 1) * 0.5), (F.col("n") - 1).cast("double"))
    return p.where((F.col("n") <= 3) | F.array_contains(picks, F.col("i").cast("double"))).select("query_id", "grp", "frame_idx", "rank")


@query("group_by_video_display", "SELECT query_id, video_id, frame_idx, row_number() OVER (PARTITION BY query_id ORDER BY best, video_id, frame_idx) AS pos FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, video_id) AS best FROM run_a)")
def group_by_video_display(t):
    a = t.run("a").withColumn("best", F.min("rank").over(Window.partitionBy("query_id", "video_id")))
    return a.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "video_id", "frame_idx"))).select("query_id", "video_id", "frame_idx", "pos")


