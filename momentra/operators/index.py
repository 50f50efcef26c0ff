"""Indexes on disk: BM25 postings, clustered vectors, and a hierarchical graph over blocks of vectors.

Each index is built under a path with a signature of its corpus and settings. ``open`` refuses an
index whose signature is another one; ``ensure`` builds it anew. The signature is written last, so an
index whose writer was lost has none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources import store
from . import bm25
from .ann import cell_scores, fit_cells
from .fusion import top_k


class StaleIndex(ValueError):
    """The index at a path is missing, incomplete, or of another corpus or other settings."""


class _Index:
    """A folder of tables that counts once its signature is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, corpus: DataFrame, path: str, **settings):
        index = cls(corpus.sparkSession, path)
        if not store.exists(index.spark, f"{index.path}/signature/_SUCCESS"):
            raise StaleIndex(f"no complete index at {path}")
        if index.table("signature").first()[0] != store.signature(corpus, cls.__name__, sorted(settings.items())):
            raise StaleIndex(f"the index at {path} is of another corpus or other settings")
        return index

    @classmethod
    def build(cls, corpus: DataFrame, path: str, **settings):
        index = cls(corpus.sparkSession, path)
        store.drop(index.spark, index.path)
        index._write(corpus, **settings)
        signed = index.spark.createDataFrame([(store.signature(corpus, cls.__name__, sorted(settings.items())),)], "signature string")
        signed.coalesce(1).write.parquet(f"{index.path}/signature")
        return index

    @classmethod
    def ensure(cls, corpus: DataFrame, path: str, **settings):
        try:
            return cls.open(corpus, path, **settings)
        except StaleIndex:
            return cls.build(corpus, path, **settings)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


class TextIndex(_Index):
    """Postings and document frequencies dealt by token, and one row of totals.

    A search reads the parts of its own tokens only (partition pruning), and in them the row groups
    that can hold the token.
    """

    PARTS = 64

    def _write(self, docs: DataFrame) -> None:
        posted = bm25.postings(docs).withColumn("part", self._part(F.col("token")))
        posted.repartition("part").sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{self.path}/postings")
        df, totals = bm25.statistics(self.table("postings"))
        df.withColumn("part", self._part(F.col("token"))).repartition("part").sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{self.path}/df")
        totals.write.parquet(f"{self.path}/totals")

    def _part(self, token):
        return F.pmod(F.xxhash64(token), F.lit(self.PARTS)).cast("int")

    def score(self, queries: DataFrame, candidates: DataFrame | None = None, **params) -> DataFrame:
        """``query_id, key, score`` of ``queries (query_id, text)``, as ``bm25.score`` gives them."""
        asked = bm25.asked(queries)
        tokens = asked.select("token", self._part(F.col("token")).alias("part")).distinct()
        parts = [r["part"] for r in tokens.select("part").distinct().collect()]  # at most PARTS numbers
        posted, df = (self.table(n).where(F.col("part").isin(parts)).join(tokens, ["part", "token"], "left_semi").drop("part") for n in ("postings", "df"))
        return bm25.score_postings(posted, df, self.table("totals"), asked, candidates, **params)


class VectorIndex(_Index):
    """Vectors dealt to the best of some centroids; a search reads its best cells only."""

    def _write(self, vectors: DataFrame, cells: int) -> None:
        centers = fit_cells(vectors, cells)
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{self.path}/centers")
        best = F.element_at(F.array_sort(cell_scores("v", centers)), -1)["cell"]
        vectors.select("global_id", "v", best.alias("cell")).repartition("cell", F.pmod("global_id", F.lit(16))).write.partitionBy("cell").parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """``query_id, global_id, score, rank`` for ``queries (query_id, qv)``."""
        centers = np.array([r["center"] for r in self.table("centers").orderBy("cell").collect()])  # as many rows as cells
        asked = queries.select("query_id", "qv", F.explode(F.slice(F.reverse(F.array_sort(cell_scores("qv", centers))), 1, probes)).alias("p")).select("query_id", "qv", F.col("p.cell").alias("cell"))
        hits = self.table("cells").join(asked, "cell").select("query_id", "global_id", dot(F.col("qv"), F.col("v")).alias("score"))
        return top_k(hits, k, ["query_id"])


def _links(x: np.ndarray, nodes: np.ndarray, m: int) -> np.ndarray:
    """For each of ``nodes`` the ``m`` nearest others by inner product, and chance links that tie the graph together."""
    out = np.full((len(nodes), 2 * m), -1, np.int32)
    rng = np.random.default_rng(len(nodes))
    for a in range(0, len(nodes), 1024):
        s = x[nodes[a : a + 1024]] @ x[nodes].T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near = np.argsort(-s, axis=1, kind="stable")[:, : min(m, len(nodes) - 1)]
        out[a : a + len(s), : near.shape[1]] = nodes[near]
    if len(nodes) > 1:
        out[:, m:] = nodes[rng.integers(0, len(nodes), (len(nodes), m))]
    return out


def _levels(n: int, m: int) -> list[np.ndarray]:
    """The nodes of each level, all of them at the bottom, an ``m``-th of a level at the next."""
    rng, levels = np.random.default_rng(n), [np.arange(n)]
    while len(levels[-1]) > 4 * m:
        levels.append(np.sort(rng.choice(levels[-1], max(1, len(levels[-1]) // m), replace=False)))
    return levels


class _Graph:
    """One block's layered graph: a descent through the upper levels, then a beam search at the bottom."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, [dict(zip(nodes.tolist(), links, strict=True)) for nodes, links in levels]

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        start = next(iter(self.levels[-1]))
        found = [(float(self.x[start] @ q), start)]
        for depth in range(len(self.levels) - 1, -1, -1):
            found = self._beam(q, found, ef if depth == 0 else 1, self.levels[depth])
        return found

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, links: dict[int, np.ndarray]) -> list[tuple[float, int]]:
        seen = {i for _, i in start}
        todo, best = [(-s, i) for s, i in start], list(start)
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            new = [j for j in dict.fromkeys(links[i].tolist()) if j >= 0 and j not in seen]
            seen.update(new)
            for v, j in zip((self.x[new] @ q).tolist(), new, strict=True) if new else ():
                if len(best) < ef or v > best[0][0]:
                    heapq.heappush(todo, (-v, j))
                    heapq.heappush(best, (v, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return best


class GraphIndex(_Index):
    """A hierarchical navigable graph for each block of vectors; the blocks' best rows are merged.

    Blocks are dealt by id hash and hold about ``block`` rows, so a graph is built from exact neighbours
    in bounded memory, and a lost block is built again alone. A block's row on disk has its ids, vectors
    and, for each level, nodes and links.
    """

    def _write(self, vectors: DataFrame, block: int, m: int) -> None:
        n = max(1, -(-vectors.count() // block))
        dealt = vectors.select("global_id", "v", F.pmod(F.xxhash64("global_id"), F.lit(n)).cast("int").alias("block"))

        def graph(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("global_id")
            x = np.stack(rows["v"].to_numpy()).astype("<f8")
            levels = _levels(len(x), m)
            return pd.DataFrame({
                "block": [rows["block"].iloc[0]], "ids": [rows["global_id"].to_numpy().astype("<i8").tobytes()], "x": [x.tobytes()], "dim": [x.shape[1]],
                "nodes": [[v.astype("<i4").tobytes() for v in levels]], "links": [[_links(x, v, m).astype("<i4").tobytes() for v in levels]],
            })

        dealt.groupBy("block").applyInPandas(graph, "block int, ids binary, x binary, dim int, nodes array<binary>, links array<binary>").write.parquet(f"{self.path}/blocks")

    def search(self, queries: DataFrame, k: int, ef: int = 128, together: int = 512) -> DataFrame:
        """``query_id, global_id, score, rank`` for ``queries (query_id, qv)``; sets of about ``together`` queries meet each block."""
        n = max(1, -(-queries.count() // together))
        sets = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("set")).agg(F.collect_list(F.struct("query_id", "qv")).alias("asked"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = graph = ids = None
            for b in batches:
                for block, raw_ids, raw, dim, nodes, links, asked in b.itertuples(index=False):
                    if block != at:
                        at, ids = block, np.frombuffer(raw_ids, "<i8")
                        levels = [np.frombuffer(v, "<i4") for v in nodes]
                        graph = _Graph(np.frombuffer(raw, "<f8").reshape(-1, dim), [(v, np.frombuffer(w, "<i4").reshape(len(v), -1)) for v, w in zip(levels, links, strict=True)])
                    out = [(a["query_id"], int(ids[i]), s) for a in asked for s, i in sorted(graph.search(np.asarray(a["qv"]), ef), reverse=True)[:k]]
                    yield pd.DataFrame(out, columns=["query_id", "global_id", "score"])

        pairs = self.table("blocks").join(sets.select("asked")).sortWithinPartitions("block")
        return top_k(pairs.mapInPandas(run, "query_id long, global_id long, score double"), k, ["query_id"])
