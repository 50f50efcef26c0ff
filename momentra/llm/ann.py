"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

Both halves of the vectors are quantised separately; a cell is a pair of centroids. A query walks
the pairs by summed centroid distance (minus the inner product with either centroid) with a heap
until the cells seen hold ``visit`` of all vectors and ``k`` besides the query's own. The entries of those cells are reranked by exact
inner products, summed in double precision in component order.

Neighbouring cells share a tile of bounded size and a larger cell is cut into several, so a hot cell
spreads over many tasks. Queries go to the tiles of the cells they visit in blocks, each vector once
a tile; tiles meet bounded groups of queries, and only the best ``k`` of a query and tile leave a task.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, neither as query nor as candidate; rows without an id likewise.
Ties go to the smaller id. Repeated rows are all candidates (but a query's own id is not). Fewer
candidates than ``k`` in all: all of them. Empty table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


def _kmeans(data: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(data, axis=0)
    centers = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = _nearest(data, centers)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, data)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def _nearest(data: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * data @ centers.T).argmin(1)


def traverse(left: np.ndarray, right: np.ndarray, counts: np.ndarray, need: float) -> list[int]:
    """Cells (``i * len(right) + j``) by growing ``left[i] + right[j]`` until they hold ``need`` entries.

    The multi-sequence walk: the heap holds the frontier of the sorted grid only.
    """
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, cells, seen = [(left[a[0]] + right[b[0]], 0, 0)], [], 0
    pushed = {(0, 0)}
    while heap and seen < need:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(right) + int(b[j])
        if counts[cell]:
            cells.append(cell)
            seen += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return cells


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, each summed in component order: equal vectors get equal scores anywhere."""
    out = np.zeros((len(queries), len(vectors)))
    for d in range(vectors.shape[1]):
        out += queries[:, d, None] * vectors[None, :, d]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best finite scores, ties to the smaller id."""
    ok = np.flatnonzero(scores > -np.inf)
    if len(ok) > k:
        cut = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= cut]
    return ok[np.lexsort((ids[ok], -scores[ok]))[:k]]


def tiles(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first tile and number of tiles: neighbouring small cells share one, a larger cell is cut."""
    first, parts = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // block))
    tile, held = 0, 0
    for cell, n in enumerate(counts):
        if n > block or held + n > block:
            tile, held = tile + (held > 0), 0
        first[cell] = tile
        if n > block:
            tile += int(parts[cell])
        else:
            held += int(n)
    return first, parts


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    centroids: int = 32, visit: float = 0.6, sample: int = 20_000, rounds: int = 12, block: int = 16_384, together: int = 256, seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows where ``is_query`` holds, against all rows.

    The codebooks are fitted on at most ``sample`` rows (those with the smallest id hashes); every
    row is indexed. ``visit`` is the share of the index a query's cells must hold: on data without
    any structure recall 0.9 needs about half, on clustered data far less. A task reranks at most
    ``block`` entries against about as many queries, ``together`` of them at a time.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)")
    size = raw.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not size:
        return spark.createDataFrame([], schema)
    dim = size[0]["d"]
    raw = raw.where(F.size("v") == dim)
    rows = raw.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").collect()  # bounded by ``sample``
    train = np.array([r["v"] for r in rows])
    half = max(1, dim // 2)
    c1 = _kmeans(train[:, :half], centroids, rounds, seed)
    c2 = _kmeans(train[:, half:], centroids, rounds, seed + 1) if dim > half else np.zeros((1, 0))
    n_cells = len(c1) * len(c2)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                cell = _nearest(x[:, :half], c1) * len(c2) + (_nearest(x[:, half:], c2) if dim > half else 0)
                yield pd.DataFrame({"id": b["id"], "v": [r.astype("<f8").tobytes() for r in x], "q": b["q"], "cell": cell.astype(np.int32)})

    index = shared.written(raw.mapInPandas(assign, "id long, v binary, q boolean, cell int"), "imi")
    counts, n_queries = np.zeros(n_cells, np.int64), 0
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("q").alias("q")).collect():  # at most one row a pair of centroids
        counts[r["cell"]] = r["n"]
        n_queries += r["q"]
    first, parts = tiles(counts, block)
    groups = max(1, -(-n_queries // block))
    need = visit * counts.sum()

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each tile that queries visit: their ids, vectors and cells, a row for ``together`` queries."""
        for b in batches:
            for at in range(0, len(b), together):
                some = b.iloc[at : at + together]
                v = np.stack([np.frombuffer(x, "<f8") for x in some["v"]])
                part = zlib.crc32(some["id"].to_numpy()[:1].tobytes()) % groups
                visits: dict[int, dict[int, list[int]]] = {}
                for i, (x, own) in enumerate(zip(v, some["own"], strict=True)):
                    for cell in traverse(-(c1 @ x[:half]), -(c2 @ x[half:]), counts, max(need, k + own)):
                        for tile in range(first[cell], first[cell] + parts[cell]):
                            visits.setdefault(tile, {}).setdefault(i, []).append(cell)
                out = []
                for tile, by in visits.items():
                    who = [*by]
                    out.append((tile, part, some["id"].to_numpy()[who].tobytes(), v[who].tobytes(), np.array([len(by[i]) for i in who], "<i4").tobytes(), np.concatenate([by[i] for i in who]).astype("<i4").tobytes()))
                    if len(out) == 32:
                        yield pd.DataFrame(out, columns=["tile", "part", "ids", "qv", "n", "cells"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["tile", "part", "ids", "qv", "n", "cells"])

    def rerank(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(entries["cell"].to_numpy(), kind="stable")
        ids, cell = entries["id"].to_numpy()[order], entries["cell"].to_numpy()[order]
        x = np.stack([np.frombuffer(v, "<f8") for v in entries["v"].to_numpy()[order]]) if len(entries) else np.zeros((0, dim))
        out: list[tuple] = []
        for row in queries.itertuples() if len(ids) else ():
            own, v = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.qv, "<f8").reshape(-1, dim)
            who = np.repeat(np.arange(len(own)), np.frombuffer(row.n, "<i4"))
            seen = np.frombuffer(row.cells, "<i4")
            scores = np.full((len(own), len(ids)), -np.inf)
            for c in np.unique(seen):
                a, z = np.searchsorted(cell, [c, c + 1])
                if z > a:
                    q = who[seen == c]
                    scores[q, a:z] = exact_scores(v[q], x[a:z])
            for qid, s in zip(own, scores, strict=True):
                s[ids == qid] = -np.inf
                best = _best(s, ids, k)
                out.append((np.full(len(best), qid), ids[best], s[best]))
        names = ("query_id", "vec_id", "score")
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*(out or [empty]), strict=True)), strict=True)))

    where = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts, strict=True))], "cell int, first int, parts int")
    entries = index.join(F.broadcast(where), "cell").select("id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts"))).cast("int").alias("tile"))
    entries = entries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    repeated = index.groupBy("id").agg(F.count("*").alias("own")).where("own > 1")  # rows of a query's own id are no candidates
    wanted = index.where("q").join(repeated, "id", "left").select("id", "v", F.coalesce("own", F.lit(1)).alias("own")).mapInPandas(probes, "tile int, part int, ids binary, qv binary, n binary, cells binary")
    found = entries.groupBy("tile", "part").cogroup(wanted.groupBy("tile", "part")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    # (Spark keeps the best k of a query in each task before they meet)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    return search(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
