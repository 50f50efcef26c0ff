"""Sharding by extendible hashing: a directory over hash-prefix bits.

A document's key is 60 bits of a digest of its id, followed by 60 bits that tell rows of equal id
apart. A bucket is a key prefix; only a bucket over the byte limit is split on one more bit. So a
document's shard is its shortest prefix whose bucket fits. Bytes are pre-aggregated by a fine prefix,
summed for all its ancestors at once, and only fine buckets that are still too large go another step
down. The rows of a repeated id part only where their bucket holds nothing else, on the second 60
bits (``page``), so a hot id spreads over as many shards as its bytes need.

Defined cases: null text has 0 bytes; a null ``doc_id`` is hashed as the empty string; one document
over the limit is a shard of its own, no other shard exceeds the limit; which shard a row of a
repeated id takes depends on the layout; an empty table gives no rows; further columns are kept by
``write_shards``, whatever their names, and ignored by ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KEY_BITS = 60


def key_of(doc_id: Column) -> Column:
    """60 digest bits as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _bits(total: int, limit: int) -> int:
    """Prefix bits of which a bucket's usual bytes are far below the limit."""
    return min(KEY_BITS, max(1, (2 * total // limit).bit_length()) + 3)


def _split(rows: DataFrame, within: list[str], key: str, low: int, fine: int, limit: int, step: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``depth, prefix, bucket`` of their shortest prefix of ``key`` that fits, and the rows for which none does."""
    done, rest = None, rows
    while True:
        at = [*within, "cell"]
        placed = rest.withColumn("cell", F.shiftright(key, KEY_BITS - fine))
        # all ancestors of a fine bucket, from the depth above which everything is too large
        cells = placed.groupBy(*at).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        up = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(fine))).alias("depth"))
        up = up.withColumn("prefix", F.expr(f"shiftright(cell, {fine} - depth)"))
        of = [*within, "depth", "prefix"]
        sums = up.groupBy(*of).agg(F.sum("b").alias("bucket"), F.sum("n").alias("rows"))
        fits = up.join(sums, of).where((F.col("bucket") <= limit) | (F.col("rows") == 1))
        found = fits.groupBy(*at).agg(F.min(F.struct("depth", "prefix", "bucket")).alias("leaf")).select(*at, "leaf.*")
        found = shared.written(found, "directory")
        now = placed.join(found, at).drop("cell")
        done = now if done is None else done.unionByName(now)
        rest = shared.written(placed.join(found, at, "left_anti").drop("cell"), "oversized")
        if fine == KEY_BITS or not shared.some(rest):
            return done, rest
        low, fine = fine + 1, min(KEY_BITS, fine + step)


def _leaves(rows: DataFrame, limit: int, step: int) -> DataFrame:
    """``rows (key, row, n_bytes, ...)`` with ``shard, depth, page, shard_bytes``; ``rows`` must be a written table."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, rest = _split(rows, [], "key", 0, _bits(total, limit), limit, step)
    out = done.withColumnsRenamed({"prefix": "shard", "bucket": "shard_bytes"}).withColumn("page", F.lit(0).cast("long"))
    if shared.some(rest):
        most = rest.groupBy("key").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0]
        done, _ = _split(rest, ["key"], "row", 1, _bits(most, limit), limit, step)
        done = done.withColumnsRenamed({"prefix": "page", "bucket": "shard_bytes"}).withColumn("shard", F.col("key")).withColumn("depth", F.col("depth") + KEY_BITS)
        out = out.unionByName(done)
    return out


def _sized(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of every row with its key, a hashed row number and its bytes."""
    row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS)
    n_bytes = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return docs.select(*columns, key_of(F.col("doc_id")).alias("key"), row.alias("row"), n_bytes.alias("n_bytes"))


@shared.tidied
def assign(docs: DataFrame, limit: int = 1 << 20, step: int = 8) -> DataFrame:
    """``doc_id, shard, depth, page, n_bytes, shard_bytes`` for every row.

    ``shard`` is the prefix as a number of ``depth`` bits (of 60 at most), ``page`` the bits after them.
    """
    sizes = shared.written(_sized(docs, F.col("doc_id")), "sizes")
    return _leaves(sizes, limit, step).select("doc_id", "shard", "depth", "page", "n_bytes", "shard_bytes")


@shared.tidied
def _assigned_rows(docs: DataFrame, limit: int, step: int) -> DataFrame:
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("own")
    return _leaves(shared.written(_sized(docs, own), "rows"), limit, step)


def write_shards(docs: DataFrame, path: str, limit: int = 1 << 20, step: int = 8) -> tuple[str, str, str]:
    """Writes ``docs`` under one folder a shard; returns the names of the three partition columns.

    They are ``shard_depth, shard, page``, with underscores in front where ``docs`` has such a column.
    The rows are written to the shared folder once, so that a row and its shard belong together.
    """
    names = tuple(shared.free_name(docs, n) for n in ("shard_depth", "shard", "page"))
    own = [F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    out = _assigned_rows(docs, limit, step).select(*own, *[F.col(c).alias(n) for c, n in zip(("depth", "shard", "page"), names, strict=True)])
    out.repartition(*names).write.partitionBy(*names).parquet(path)
    return names


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(shared.table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key,
    CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
up AS (SELECT d.*, depth, key >> (60 - depth) AS shard FROM d, range(0, 61) AS r(depth)),
sums AS (SELECT depth, shard, sum(n_bytes) AS b, count(*) AS n FROM up GROUP BY depth, shard),
fit AS (SELECT up.doc_id, up.n_bytes, up.depth, up.shard, b, row_number() OVER (PARTITION BY up.doc_id ORDER BY up.depth) AS r
  FROM up JOIN sums ON up.depth = sums.depth AND up.shard = sums.shard WHERE b <= 1048576 OR n = 1)
SELECT doc_id, CAST(shard AS BIGINT) AS shard, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, n_bytes, CAST(b AS BIGINT) AS shard_bytes FROM fit WHERE r = 1
"""
