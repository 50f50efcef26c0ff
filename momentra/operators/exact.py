"""Exact best rows of every query by inner product, tile by tile.

All pairs are scored, but none is moved: a task gets a part of the rows and a block of queries, finds
by one matrix product which pairs can be among the best, sums only those as SQL does (component after
component, so that equal vectors tie) and returns the best rows of each query in its part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fusion import top_k

NUMBER, NULL = 1, 2  # classes of scores in order: 0 is no number, which sorts as the largest
NO_ID = np.iinfo(np.int64).max


def best(rows: DataFrame, asked: DataFrame, k: int, sizes: tuple[int, int], block: int = 4096, chunk: int = 8192) -> DataFrame:
    """``query_id, global_id, score, rank``: the ``k`` rows of the largest inner products, ties by the smaller id.

    ``rows (global_id, v)`` against ``asked (query_id, qv)``; ``sizes`` are their counts, which only set
    the number of tiles. A task holds ``block`` queries with their best rows and ``chunk`` rows. Null or
    unlike vectors have null scores, which come last.
    """
    blocks = max(1, -(-sizes[1] // block))
    parts = max(1, min(-(-rows.sparkSession.sparkContext.defaultParallelism // blocks), -(-sizes[0] // chunk)))
    x = rows.select(F.lit(1).alias("side"), F.col("global_id").alias("id"), "v", F.pmod(F.xxhash64("global_id"), F.lit(parts)).alias("part"))
    q = asked.select(F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("qv").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    x = x.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tiles = q.unionByName(x).select((F.col("block") * parts + F.col("part")).cast("int").alias("tile"), "side", F.col("id").cast("long").alias("id"), "v")
    dealt = tiles.repartitionById(blocks * parts, F.col("tile")).sortWithinPartitions("tile", "side")
    found = dealt.mapInArrow(partial(_search, k=k, chunk=chunk), "query_id long, global_id long, score double")
    return top_k(found, k, ["query_id"])


def _search(batches: Iterator[pa.RecordBatch], k: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Tiles one after the other: first its queries, then its rows in any order."""
    at, held, size, tile = (None, None), [], 0, None

    def close():
        nonlocal tile, held, size
        if size:
            ids, x, ok = (np.concatenate(p) for p in zip(*held, strict=True))
            if at[1] == 0:
                tile = _Tile(ids, x, ok, k)
            elif tile is not None:
                tile.add(ids, x, ok)
        held, size = [], 0

    for b in batches:
        keys = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a == z:
                continue
            here = (int(keys[a]) // 2, int(keys[a]) % 2)
            if here != at:
                close()
                if here[0] != at[0]:
                    if tile is not None:
                        yield from tile.found()
                    tile = None
                at = here
            if tile is None and here[1] == 1:
                continue  # no query in this tile
            for i in range(int(a), int(z), chunk):
                part = b.slice(i, min(chunk, int(z) - i))
                if here[1] == 1 and size + part.num_rows > chunk:
                    close()
                held.append((part.column(2).fill_null(NO_ID).to_numpy(zero_copy_only=False), *_matrix(part.column(3), tile.dim if tile else None, held)))
                size += part.num_rows
    close()
    if tile is not None:
        yield from tile.found()


def _matrix(v: pa.Array, dim: int | None, held: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one width, and which of them are whole; the longest of a tile's first queries sets the width."""
    n = np.asarray(v.value_lengths().fill_null(-1))
    if dim is None:
        dim = held[0][1].shape[1] if held else max(int(n.max()), 0)
    flat = v.flatten()
    if (n == dim).all() and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).reshape(-1, dim), np.ones(len(n), bool)
    x, ok = np.zeros((len(n), dim)), n == dim
    for i, row in enumerate(v.to_pylist()):
        ok[i] = ok[i] and None not in row
        if ok[i]:
            x[i] = row
    return x, ok


def _lengths(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and which vectors have one that products can be bounded by."""
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(1))
        return length, ok & (length < 1e150) & ((length > 1e-140) | ~x.any(1))


def _units(x: np.ndarray, length: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Directions in single precision, all zero where there is none."""
    there = (plain & (length > 0))[:, None]
    return np.divide(x, length[:, None], out=np.zeros(x.shape), where=there).astype(np.float32)


def _places(can: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a table with few true cells and a width of whole words."""
    words = np.flatnonzero(can.view(np.uint64))
    word, byte = np.nonzero(can.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + byte, can.shape[1])


class _Tile:
    """A block of queries and the best rows of each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, ok: np.ndarray, k: int, together: int = 128):
        self.ids, self.q, self.ok, self.k, self.together = ids, q, ok, k, together
        self.dim, m = q.shape[1], len(ids)
        self.columns = np.ascontiguousarray(q.T)
        self.length, self.plain = _lengths(q, ok)
        self.unit = _units(q, self.length, self.plain)
        self.n = np.zeros(m, np.int64)
        self.score, self.kind, self.row = np.zeros((m, k)), np.full((m, k), NULL, np.int8), np.zeros((m, k), np.int64)
        self.least = np.full(m, -np.inf)  # what a pair must reach
        self.waiting: dict[int, list] = {}  # pairs of a group of queries that are not merged yet

    def add(self, ids: np.ndarray, x: np.ndarray, ok: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x, ok = ids[order], np.ascontiguousarray(x[order]), ok[order]
        # equal vectors are scored once; ids stay in order inside each group
        marked = np.ascontiguousarray(np.column_stack([x, ok.astype(float)]))
        _, first, group = np.unique(marked.view(np.dtype((np.void, marked.dtype.itemsize * marked.shape[1]))).ravel(), return_index=True, return_inverse=True)
        members, x, ok = np.argsort(group.ravel(), kind="stable"), x[first], ok[first]
        count = np.bincount(group.ravel(), minlength=len(first))
        start = np.cumsum(count) - count
        columns = np.ascontiguousarray(x.T)
        length, plain = _lengths(x, ok)
        longest = length[plain].max(initial=0.0)
        plain &= (length == 0) | (length > longest * 1e-18)
        odd = np.flatnonzero(~plain)
        clean = np.where(plain[:, None], x, 0.0).T
        n = len(x)
        # cosines less what a pair of this length must reach, in single precision: only pairs above are looked at again
        wide = np.zeros((self.dim + 1, -(-n // 8) * 8), np.float32)
        wide[:-1, :n] = _units(x, length, plain).T
        wide[-1, :n] = np.divide(longest, length, out=np.ones(n), where=plain & (length > 0))
        loose = np.float32(-4 * (self.dim + 2) * np.finfo(np.float32).eps)
        for a in range(0, len(self.ids), self.together):
            some = np.arange(a, min(a + self.together, len(self.ids)))
            reach = np.divide(self.least[some], np.where(self.length[some] > 0, self.length[some], 1.0) * (longest or 1.0), out=np.zeros(len(some)), where=self.plain[some])
            can = np.column_stack([self.unit[some], -reach.clip(-1e18, 1e18).astype(np.float32)]) @ wide >= loose
            can[:, n:] = False
            many = np.flatnonzero(can.sum(1) > 2 * self.k)
            if len(many) and n > self.k:
                can[many, :n] = self._nearest(some[many], clean, longest, odd)
            can[:, odd] = True
            can[~self.plain[some], :n] = True
            who, which = _places(can)
            if len(who):
                self._score(a, some[who], which, columns, ok, ids, members, start, count)

    def _nearest(self, some: np.ndarray, clean: np.ndarray, longest: float, odd: np.ndarray) -> np.ndarray:
        """Which rows can be among the best: in double precision, also against the other rows at hand."""
        near = np.where(self.plain[some, None], self.q[some], 0.0) @ clean
        near[:, odd] = -np.inf
        # twice and more what a product and a plain sum can differ by
        slack = 4 * (self.dim + 2) * np.finfo(float).eps * np.where(self.plain[some], self.length[some], 0.0) * longest + 1e-300
        kth = np.partition(near, near.shape[1] - self.k, axis=1)[:, -self.k]
        return near >= np.maximum(self.least[some] - slack, kth - 2 * slack)[:, None]

    def _score(self, a: int, who, which, columns, ok, ids, members, start, count) -> None:
        score = np.zeros(len(who))
        with np.errstate(all="ignore"):
            for mine, theirs in zip(self.columns, columns, strict=True):
                score += mine[who] * theirs[which]
        kind = np.where(self.ok[who] & ok[which], np.where(np.isnan(score), 0, NUMBER), NULL).astype(np.int8)
        score[kind != NUMBER] = 0.0
        stays = (kind != NUMBER) | (score >= self.least[who])
        who, which, score, kind = who[stays], which[stays], score[stays], kind[stays]
        if not len(who):
            return
        copies = np.minimum(count[which], self.k)  # the first of equal vectors, by id
        each = np.repeat(np.arange(len(who)), copies)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
        row = ids[members[start[which[each]] + nth]]
        held = self.waiting.setdefault(a, [])
        held.append((who[each], score[each], kind[each], row))
        if sum(len(h[0]) for h in held) >= self.together * self.k // 2:
            self._merge(a)

    def _merge(self, a: int) -> None:
        who, score, kind, row = (np.concatenate(p) for p in zip(*self.waiting.pop(a), strict=True))
        some = np.unique(who)
        old = np.arange(self.k) < self.n[some, None]
        who = np.concatenate([np.repeat(some, self.n[some]), who])
        score, kind, row = (np.concatenate([kept[some][old], new]) for kept, new in ((self.score, score), (self.kind, kind), (self.row, row)))
        order = np.lexsort((row, -score, kind, who))
        who = who[order]
        begin = np.searchsorted(who, some)
        total = np.diff(np.append(begin, len(who)))
        place = np.arange(len(who)) - np.repeat(begin, total)
        top = place < self.k
        who, place, order = who[top], place[top], order[top]
        self.score[who, place], self.kind[who, place], self.row[who, place] = score[order], kind[order], row[order]
        self.n[some] = np.minimum(total, self.k)
        last = self.kind[some, self.k - 1]
        bar = np.where(last == NUMBER, self.score[some, self.k - 1], np.where(last == NULL, -np.inf, np.inf))
        self.least[some] = np.where(self.n[some] == self.k, bar, -np.inf)

    def found(self, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        for a in list(self.waiting):
            self._merge(a)
        there = np.arange(self.k) < self.n[:, None]
        who = np.repeat(self.ids, self.n)
        row, score, kind = self.row[there], self.score[there], self.kind[there]
        score[kind == 0] = np.nan
        for a in range(0, len(who), rows):
            z = a + rows
            yield pa.RecordBatch.from_arrays([pa.array(who[a:z]), pa.array(row[a:z], mask=row[a:z] == NO_ID), pa.array(score[a:z], mask=kind[a:z] == NULL)], names=["query_id", "global_id", "score"])
