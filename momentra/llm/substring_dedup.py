"""Substring dedup: a log-structured index of window fingerprints, merged batch by batch.

Documents are dealt by ``doc_id`` range and written once as chunks (one row holds some megabytes of
text, chunks ascend with ``doc_id``). Chunks enter in batches. A batch's windows are hashed, sorted
and dealt by hash prefix; inside a prefix the sorted lists of the batch are merge-joined with the
sorted immutable runs of earlier batches. A key is 64 hash bits; a match counts only once verified
by a second, independent fingerprint. Keys seen in an earlier chunk or run go back to their chunk as
a sorted list; the batch's new keys become one more run. Runs are one table bucketed by prefix, so a
merge reads them where they lie and only the batch is shuffled; ``fan_in`` runs of a level are
compacted into one of the next. The last step covers the words of matched windows, chunk by chunk.

``FingerprintIndex`` outlives a call: ``create`` one and pass its path to ``dedup`` with each day's
documents, in any session. All that is in it counts as earlier than the documents of a call.

No row is made per window: lists travel as delta-coded, compressed blobs of bounded size, and a
passage that a third of all documents share costs one key a list.

Defined cases: null text has no words; a text of fewer words than a window keeps all; rows with a null
``doc_id`` neither remove nor are removed from; rows with equal ``doc_id`` don't remove each other's
words; an empty table gives no rows; further columns pass through ``cut`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .hashing import Texts

_CHUNK = 1 << 20
#: Keys to a list: about four to each of its prefixes at least.
_LIST = 1_000_000
_MOST_BITS = 23
#: Chunk rows to a Python batch: some megabytes.
_ROWS = 16


def _squeeze(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte planes apart (the high ones vanish when compressed)."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    planes = [np.ascontiguousarray(step).tobytes(), *(np.ascontiguousarray(o.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes() for o in others)]
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _expand(blob: bytes, others: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=n * (8 + 2 * others) + 64), np.uint8)
    out = [np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)]
    for k in range(others):
        part = raw[n * (8 + 2 * k) : n * (10 + 2 * k)]
        out.append(np.ascontiguousarray(part.reshape(2, n).T).view("<u2").ravel())
    return out


def _chunk_rows(limit: int):
    """Groups a partition's rows (sorted by doc_id) into chunk rows; equal ids stay in one chunk."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ids, texts, rest, held, part = 0, [], [], [], 0, 0

        def out():
            carried = pa.concat_arrays(rest)
            lists = [pa.array([(part << 24) + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(carried)], pa.int32()), carried)]
            return pa.RecordBatch.from_arrays(lists, names=["chunk", "ids", "texts", "rest"])

        for b in batches:
            start = 0
            for i, (part, doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):  # noqa: B007
                if held >= limit and ids[-1] != doc:
                    rest.append(b.column(3).slice(start, i - start))
                    yield out()
                    n, ids, texts, rest, held, start = n + 1, [], [], [], 0, i
                ids.append(doc)
                texts.append((text.as_py() or "").encode())
                held += len(texts[-1]) + 16
            rest.append(b.column(3).slice(start))
        if ids:
            yield out()

    return rows


def _unique_first(keys: np.ndarray, check: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions of the first entry (smallest owner) of each key and check, in key order."""
    order = np.lexsort((owner, check, keys))
    k, c = keys[order], check[order]
    first = np.ones(len(order), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order[first]


def _lists(size: int, bits: int):
    """Sorted distinct window keys of whole chunks, one row a hash prefix and list."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, checks, owners, chunks, held = [], [], [], [], 0

        def flush():
            k, c, o = np.concatenate(keys), np.concatenate(checks), np.concatenate(owners)
            order = np.argsort(k, kind="stable")
            k, c, o = k[order], c[order], o[order]
            edge = np.searchsorted(k >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            got = [(p, _squeeze(k[a:z], c[a:z], o[a:z])) for p, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([chunks] * len(got), pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.binary())], names=["prefix", "chunks", "keys"])

        for b in batches:
            for chunk, ids, texts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                t = Texts(texts.as_py())
                k, at = t.windows(size)
                c = (t.windows(size, 1)[0] & np.uint64(0xFFFF)).astype(np.uint16)
                known = np.array([x is not None for x in ids.as_py()], bool)[t.doc[at]] if len(at) else np.zeros(0, bool)
                k, c = k[known], c[known]
                pick = _unique_first(k, c, np.zeros(len(k), np.uint8))
                if len(pick):
                    keys.append(k[pick])
                    checks.append(c[pick])
                    owners.append(np.full(len(pick), len(chunks), np.uint16))
                    chunks.append(chunk)
                    held += len(pick)
                if held >= max(_LIST, 4 << bits) or len(chunks) >= 1 << 16:
                    yield flush()
                    keys, checks, owners, chunks, held = [], [], [], [], 0
        if keys:
            yield flush()

    return rows


def _merge(lists: pd.DataFrame, runs: list[tuple[np.ndarray, np.ndarray]], keep_run: bool) -> Iterator[dict]:
    """Merge-joins one prefix's lists with its runs: keys for each chunk, and the new run."""
    keys, checks, owners = [], [], []
    for chunks, blob in zip(lists["chunks"], lists["keys"], strict=True):
        k, c, o = _expand(blob, 2)
        keys.append(k)
        checks.append(c)
        owners.append(np.asarray(chunks, np.int64)[o])
    if not keys:
        return
    k, c, o = np.concatenate(keys), np.concatenate(checks), np.concatenate(owners)
    order = np.lexsort((o, c, k))
    k, c, o = k[order], c[order], o[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    known = np.zeros(len(k), bool)
    for rk, rc in runs:
        at = np.searchsorted(rk, k)
        while True:  # runs hold a key twice only where two windows differ in their check
            inside = at < len(rk)
            same = inside & (rk[np.minimum(at, len(rk) - 1)] == k)
            known |= same & (rc[np.minimum(at, len(rk) - 1)] == c)
            if not (more := same & ~known).any():
                break
            at = at + more
    matched = known | ~first
    mk, mo = k[matched], o[matched]
    order = np.argsort(mo, kind="stable")
    mk, mo = mk[order], mo[order]
    edge = np.flatnonzero(np.diff(mo, prepend=-1, append=-1))
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        yield {"chunk": int(mo[a]), "keys": _squeeze(np.unique(mk[a:z]))}
    if keep_run:
        new = first & ~known
        yield {"chunk": None, "keys": _squeeze(k[new], c[new])}


def _compact(group: pd.DataFrame) -> pd.DataFrame:
    parts = [_expand(b, 1) for b in group["keys"]]
    k, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    pick = _unique_first(k, c, np.zeros(len(k), np.uint8))
    return pd.DataFrame({"prefix": [group["prefix"].iloc[0]], "keys": [_squeeze(k[pick], c[pick])]})


class FingerprintIndex:
    """Immutable sorted runs of window keys under ``root``, which driver and executors share.

    ``root/keys`` is one table partitioned by run and bucketed by hash prefix, in which a batch's
    matches are runs of another name until they have been used. ``root/log`` has a row for each
    change: the runs that count from then on. A run that the last row does not name (its writer was
    lost, or it was compacted) is no part of the index and goes when the index is opened.
    """

    def __init__(self, spark: SparkSession, root: str, size: int, bits: int, fan_in: int, runs: list[str], made: int):
        self.spark, self.root, self.size, self.bits, self.fan_in, self.runs, self.made = spark, root, size, bits, fan_in, runs, made
        self.buckets = 1 << min(max(0, bits - 2), 16)
        self.table = f"fingerprints_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (prefix INT, chunk BIGINT, keys BINARY, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY (prefix) SORTED BY (prefix) INTO {self.buckets} BUCKETS LOCATION '{root}/keys'")

    @classmethod
    def create(cls, spark: SparkSession, root: str, size: int = 13, bits: int = 12, fan_in: int = 3) -> FingerprintIndex:
        """A new, empty index of windows of ``size`` words whose keys are dealt by ``bits`` bits."""
        index = cls(spark, root.rstrip("/"), size, bits, fan_in, [], 0)
        index._log()
        return index

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index under ``root`` as its last completed change left it."""
        root = root.rstrip("/")
        last = spark.read.schema("made long, size int, bits int, fan_in int, runs array<string>").json(f"{root}/log/*").orderBy(F.desc("made")).first()
        index = cls(spark, root, last["size"], last["bits"], last["fan_in"], list(last["runs"]), last["made"])
        if shared.exists(spark, f"{root}/keys"):
            spark.sql(f"MSCK REPAIR TABLE {index.table}")
        index.drop([r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {index.table}").collect() if r[0].partition("=")[2] not in index.runs])
        return index

    def _log(self) -> None:
        self.made += 1
        row = self.spark.createDataFrame([(self.made, self.size, self.bits, self.fan_in, self.runs)], "made long, size int, bits int, fan_in int, runs array<string>")
        row.coalesce(1).write.json(f"{self.root}/log/{self.made}")

    def read(self, runs: list[str]) -> DataFrame:
        return self.spark.table(self.table).where(F.col("run").isin(runs))

    def add(self, chunks: DataFrame, keep_run: bool = True) -> str:
        """Merges a batch; returns the name of its matches. Later chunks must be larger."""
        name, bits = f"{self.made + 1}", self.bits
        lists = chunks.mapInArrow(_lists(self.size, bits), "prefix int, chunks array<long>, keys binary").repartition(self.buckets, "prefix")
        shape = "prefix int, chunk long, keys binary"

        def merge(lists: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame(list(_merge(lists, [_expand(b, 1) for b in runs["keys"]], keep_run)), columns=["chunk", "keys"])
            out.insert(0, "prefix", lists["prefix"].iloc[0] if len(lists) else 0)
            return out.astype({"chunk": "Int64"})

        if self.runs:
            runs = self.read(self.runs).select("prefix", "keys")
            merged = lists.groupBy("prefix").cogroup(runs.groupBy("prefix")).applyInPandas(merge, shape)
        else:
            merged = lists.groupBy("prefix").applyInPandas(lambda lists: merge(lists, pd.DataFrame({"keys": []})), shape)
        matches = f"matches.{name}"
        merged.select("*", F.when(F.col("chunk").isNull(), f"0.{name}").otherwise(matches).alias("run")).write.insertInto(self.table)
        if keep_run:
            self.runs = [*self.runs, f"0.{name}"]
            self._log()
            self.compact()
        else:
            self.made += 1
        return matches

    def compact(self) -> None:
        """Merges the runs of a level that has ``fan_in`` of them into one of the next level; old ones go once it is complete."""
        for level in range(64):
            old = [r for r in self.runs if r.startswith(f"{level}.")]
            if len(old) < self.fan_in:
                return
            name = f"{level + 1}.{self.made + 1}"
            merged = self.read(old).select("prefix", "keys").groupBy("prefix").applyInPandas(_compact, "prefix int, keys binary")
            merged.select("prefix", F.lit(None).cast("long").alias("chunk"), "keys", F.lit(name).alias("run")).write.insertInto(self.table)
            self.runs = [*(r for r in self.runs if r not in old), name]
            self._log()
            self.drop(old)

    def drop(self, runs: list[str]) -> None:
        for r in runs:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (run = '{r}')")
            shared.drop_path(self.spark, f"{self.root}/keys/run={r}")

    def close(self, delete: bool = False) -> None:
        """Forgets the session's table; the index stays under its root unless ``delete``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if delete:
            shared.drop_path(self.spark, self.root)


def _cover(texts: Texts, ids: list, matched: np.ndarray, size: int) -> np.ndarray:
    """Which words a window covers that is matched from outside or starts in a smaller id of the chunk."""
    k, at = texts.windows(size)
    gone = np.zeros(len(texts.start) + 1, np.int64)
    if len(k):
        doc = texts.doc[at]
        check = texts.windows(size, 1)[0] & np.uint64(0xFFFF)
        known = np.array([x is not None for x in ids], bool)[doc]
        value = np.array([x or 0 for x in ids], np.int64)[doc]
        hit = known & (np.isin(k, matched) if len(matched) else np.zeros(len(k), bool))
        order = np.lexsort((value, ~known, check, k))
        ok, oc, ov = k[order], check[order], value[order]
        start = np.ones(len(order), bool)
        start[1:] = (ok[1:] != ok[:-1]) | (oc[1:] != oc[:-1])
        least = ov[np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
        hit[order] |= known[order] & (ov > least)
        first = at[hit]
        np.add.at(gone, first, 1)
        np.add.at(gone, np.minimum(first + size, len(gone) - 1), -1)
    return np.cumsum(gone[:-1]) > 0


def _apply(size: int, with_text: bool):
    """Digests and kept text of each document of a chunk row with its matched keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, raw, carried, found in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                ids, raw, found = ids.as_py(), raw.as_py(), found.as_py() or []
                matched = np.concatenate([_expand(x, 0)[0] for x in found]) if found else np.zeros(0, np.uint64)
                t = Texts(raw)
                gone = _cover(t, ids, matched, size)
                edge = np.concatenate(([0], np.cumsum(t.count)))
                out: list[list] = [[] for _ in schema]
                for d, doc in enumerate(ids):
                    a, z = edge[d], edge[d + 1]
                    keep = ~gone[a:z]
                    words = raw[d].split()
                    if not keep.all():
                        words = [w for w, k in zip(words, keep, strict=True) if k]
                    digest = hashlib.sha256(b" ".join(words)).hexdigest()
                    removed = int(z - a - keep.sum())
                    text = raw[d] if with_text else b""
                    if removed and with_text:  # a kept word stays with the white space after it
                        s = t.start[a:z] - t.base[d]
                        stop = np.append(s[1:], len(text))
                        text = b"".join(text[i:j] for i, j, k in zip(s, stop, keep, strict=True) if k)
                    for c, v in zip(out, (doc, int(z - a), removed, digest, text.decode() if with_text else None), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(out, schema, strict=True)), carried.values], names=[*schema.names, "rest"])

    return rows


def _own_session(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` that sends a few chunk rows to a Python batch, not ten thousand."""
    own = spark.newSession()
    for row in spark.sql("SET").collect():
        if row["key"].startswith("spark.sql.") and spark.conf.isModifiable(row["key"]):
            own.conf.set(row["key"], row["value"])
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_ROWS))
    return own


def dedup(
    docs: DataFrame, size: int = 13, cuts: tuple = (0.15, 0.3, 0.5), fan_in: int = 3, prefix_bits: int | None = None, chunk_bytes: int = _CHUNK,
    carry: tuple = (), with_text: bool = True, index: str | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept, rest`` for every row.

    ``kept`` is the text left (null without ``with_text``) and ``rest`` a struct of the ``carry``
    columns, as ``c0``, ``c1``, ... ``cuts`` are the shares of the id ranges at which a batch ends.
    With the path of an ``index`` (whose window size and bits then count), windows that it holds are
    removed too, and those of ``docs`` are added; ids should ascend from call to call. Without one, an
    index serves this call alone. ``prefix_bits`` deals its keys to ``2 ** prefix_bits`` merges; by default a merge
    gets the keys of about 4 MB of text.
    """
    spark = docs.sparkSession
    parts = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.struct(F.lit(0).alias("none"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    kind = ranged.schema["rest"].dataType.simpleString()
    shape = f"chunk long, ids array<long>, texts array<binary>, rest array<{kind}>"
    rows = ranged.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text", "rest").mapInArrow(_chunk_rows(chunk_bytes), shape)
    path = shared.new_path(spark, "chunks")
    rows.write.option("compression", "zstd").parquet(path)
    del ranged, rows
    shared.release(spark)
    own = _own_session(spark)
    chunks = own.read.schema(shape).parquet(path)
    lasting = index is not None
    if lasting:
        index = FingerprintIndex.open(own, index)
    else:
        if prefix_bits is None:
            prefix_bits = min(_MOST_BITS, max(6, (chunks.count() * chunk_bytes // (4 << 20)).bit_length()))
        index = FingerprintIndex.create(own, shared.new_path(spark, "fingerprints"), size, prefix_bits, fan_in)
    found = []
    edges = [0, *(round(parts * c) for c in cuts), parts]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = chunks.select("chunk", "ids", "texts").where((F.col("chunk") >= low << 24) & (F.col("chunk") < high << 24))
        found.append(index.add(batch, keep_run=lasting or high < parts))
        del batch
        shared.release(spark)
    if not lasting:
        index.drop(index.runs)
    # at most one list a chunk, prefix and batch: a chunk's lists are bounded by its own windows
    matches = index.read(found).groupBy("chunk").agg(F.collect_list("keys").alias("found"))
    joined = chunks.join(matches, "chunk", "left").select("ids", "texts", "rest", "found")
    shape = f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, rest {kind}"
    made = shared.new_path(spark, "deduped")
    joined.mapInArrow(_apply(index.size, with_text), shape).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(made)
    del matches, joined
    index.drop(found)
    index.close(delete=not lasting)
    shared.drop_path(spark, path)
    shared.release(spark)
    return spark.read.schema(shape).parquet(made)


def cut(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with what is left of each text, and its own other columns; emptied documents go."""
    others = [c for c in docs.columns if c != "text"]
    out = dedup(docs, carry=tuple(others), **options).where("n_words > n_removed or n_words = 0")
    at = {c: f"rest.c{i}" for i, c in enumerate(others)}
    return out.select([F.col("kept").alias("text") if c == "text" else F.col(at[c]).alias(c) for c in docs.columns])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(shared.table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
wins AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS least FROM wins) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 13) AS r(k)),
kept AS (
  SELECT words.doc_id, words.i, words.word FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i WHERE gone.i IS NULL),
sums AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN sums ON w.doc_id = sums.doc_id
"""
