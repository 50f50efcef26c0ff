"""Registration of queries with their DuckDB counterparts, and the latter's common tables."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables`` as query ``name``; ``sql`` is its DuckDB counterpart."""

    def register(f):
        def run(spark, sf_dir):
            from ..sources.tables import Tables

            out = f(Tables(spark, sf_dir))
            # positions and counts are 64-bit in SQL
            return out.withColumns({c: out[c].cast("bigint") for c, kind in out.dtypes if kind == "int"})

        run.__name__, run.__doc__ = name, f.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = expand(sql)
        return f

    return register


_VIDEO = "printf('L%02d_V%03d', CAST({g} // 200 + 1 AS INTEGER), CAST({g} // 20 % 10 + 1 AS INTEGER))"
_TOKENS = r"list_filter(string_split(strip_accents(replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_\p{{M}}]+', ' ', 'g'), 'đ', 'd')), ' '), lambda x: x <> '')"

#: Common tables by name; a query that names one gets it and what it names itself.
CTES = {
    "catalog": f"SELECT vec_id AS global_id, {_VIDEO.format(g='vec_id')} AS video_id, vec_id % 20 + 1 AS n, vec_id % 20 * 125 AS frame_idx, vec_id % 20 * 5.0::DOUBLE AS pts_time, 25.0::DOUBLE AS fps, vec_id % 7 <> 3 AS has_map, label FROM embeddings",
    "vectors": "SELECT vec_id AS global_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "lane32": "SELECT global_id, list_transform(v[1:32], lambda x: x / sqrt(list_dot_product(v[1:32], v[1:32]))) AS v, label FROM vectors",
    "s64": "SELECT q.global_id // 50 AS query_id, c.global_id, list_dot_product(q.v, c.v) AS score FROM vectors c JOIN vectors q ON q.global_id % 50 = 0",
    "a64": "SELECT q.global_id AS query_id, c.global_id, list_dot_product(q.v, c.v) AS score FROM vectors c JOIN vectors q ON q.global_id % 50 = 0",
    "s32": "SELECT q.global_id // 50 AS query_id, c.global_id, list_dot_product(q.v, c.v) AS score FROM lane32 c JOIN lane32 q ON q.global_id % 50 = 0",
    "top64": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) AS rank FROM s64) WHERE rank <= 100",
    "top32": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, global_id) AS rank FROM s32) WHERE rank <= 100",
    "signals": "SELECT query_id, 'visual' AS signal, global_id, score FROM top64 UNION ALL SELECT query_id, 'alt', global_id, score FROM top32 UNION ALL SELECT query_id, 'object', global_id, global_id % 7 / 7.0::DOUBLE FROM top64 WHERE global_id % 3 = 0",
    "normed": "SELECT query_id, signal, global_id, CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id, signal) AS lo, max(score) OVER (PARTITION BY query_id, signal) AS hi FROM signals)",
    "fused": "SELECT query_id, global_id, sum(score * CASE signal WHEN 'visual' THEN 0.6 WHEN 'alt' THEN 0.4 ELSE 0.25 END) AS score FROM normed GROUP BY ALL",
    "fusedv": f"SELECT *, {_VIDEO.format(g='global_id')} AS video_id FROM fused",
    "run_a": "SELECT query_id, rank, c.video_id, c.frame_idx, 'Label ' || c.label || CASE WHEN rank % 3 = 0 THEN '.' ELSE '' END AS answer, score FROM top64 JOIN catalog c USING (global_id)",
    "run_b": "SELECT query_id, rank, c.video_id, c.frame_idx, 'Label ' || c.label || CASE WHEN rank % 3 = 0 THEN '.' ELSE '' END AS answer, score FROM top32 JOIN catalog c USING (global_id)",
    "gt": "SELECT global_id % 50 AS query_id, global_id // 50 AS event_idx, video_id, frame_idx - 60 AS lo, frame_idx + 60 AS hi, ['label ' || label] AS answers FROM catalog",
    "tracks": "SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS hours, event_id AS global_id, event_type, value FROM events",
    "detections": "SELECT l_orderkey AS frame, l_returnflag AS entity, 1 - l_discount AS score, l_tax * 10 AS x FROM lineitem",
    "segments": "SELECT conv_id AS video_id, turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + 8 AS stop, text, turn FROM conversations",
    "post": f"SELECT doc_id AS key, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(ws) AS token, len(ws) AS dl FROM (SELECT doc_id, {_TOKENS.format(t='text')} AS ws FROM documents)) GROUP BY doc_id, token",
    "asked": f"SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format(t='text')}) AS token FROM benchmark) GROUP BY ALL",
    "df": "SELECT token, count(*) AS df FROM post GROUP BY token",
    "corpus": "SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT key, any_value(dl) AS dl FROM post GROUP BY key)",
    "bm25": "SELECT query_id, key, sum(times * ln((n_docs + 1) / df) * tf * 2.5 / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf)) AS score FROM post JOIN asked USING (token) JOIN df USING (token), corpus GROUP BY query_id, key HAVING sum(times * ln((n_docs + 1) / df) * tf * 2.5 / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf)) > 1e-9",
}


def expand(sql: str) -> str:
    """Puts the common tables that ``sql`` names in front of it, each after those it needs."""
    # plain decimals are exact decimals there; all of ours are doubles
    sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])(?!::)", r"\1::DOUBLE", sql)
    order: list[str] = []
    own = set(re.findall(r"(\w+) AS \(SELECT", sql))

    def need(text: str) -> None:
        for name, body in CTES.items():
            if name not in order and name not in own and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                need(body)
                if name not in order:
                    order.append(name)

    need(sql)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    start = re.match(r"\s*WITH\s+", sql)
    if not order:
        return sql
    return f"WITH {head}, {sql[start.end():]}" if start else f"WITH {head} {sql}"
