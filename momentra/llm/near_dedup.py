"""MinHash near-dedup: BagMinHash signatures, banding, verified multiset overlap.

A text is the multiset of its five-word windows; the similarity of two texts is the weighted Jaccard
index of these multisets, and texts of 0.8 or more are linked. BagMinHash: a window's weight axis is
cut into the dyadic intervals [0,1), [1,2), [2,4), ...; each interval carries a Poisson process whose
rate is its length, seeded by window and interval; a point counts where its weight coordinate lies
below the window's weight. Points are dealt to the signature's components, which keep their earliest
one. Two signatures agree in a component with exactly the probability of the weighted Jaccard index.

Texts with equal words are one item. Items that share a band are compared with two pivots of that
band's bucket: the member that shares most bands with others, which in a group of copies is the one
in their middle, and the one with the smallest id. That settles most groups with two comparisons a
member. In buckets whose members are then still in several components, those outside the commonest
component are compared with the members of others unless that can't be a link: similar texts lack few
of each other's windows, so of a text's rarest quarter its partner has all but these. Bit masks and
lists of the rarest windows rule pairs out before any is made. So every link that shares a band is
found and no partners are capped, while a group of copies takes a few comparisons a member. A link of
similarity 0.8 shares no band with probability 7e-5 (24 bands of 5), of 0.85 with 2e-6.

Defined cases: null and empty texts (no word) have no similarity and are classes of their own; texts
of one to four words are one window of all their words; the class id is the smallest ``doc_id`` of
the class; rows with a null ``doc_id`` come back with a null class; repeated ``doc_id`` rows with
different texts are all compared and, through their common id, share one class; an empty table gives
no rows; further columns are ignored (``near_dups``) or pass through (``one_of_each``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components
from .hashing import Texts, mix

U = np.uint64


def bags(texts: list[bytes], size: int) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of each text: text index, window hash, multiplicity (sorted by text and hash)."""
    t = Texts(texts)
    h, at = t.windows(size)
    doc = t.doc[at]
    short = np.flatnonzero((t.count > 0) & (t.count < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(t.count)))[short]
        extra = []
        for d, a in zip(short, first, strict=True):
            x = U(t.count[d])
            for k in range(a, a + t.count[d]):
                x = mix(np.array([x]) * U(3) + t.hash[k : k + 1])[0]
            extra.append(x)
        h, doc = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
    return t, doc[start], h[start], np.diff(np.append(start, len(h)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def bagminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (``n_docs`` x ``m``, 64 bits a component; 0 where a text has no element)."""
    sig = np.zeros((n_docs, m), np.uint64)
    total = np.bincount(doc, weight, n_docs)
    # processes up to the time by which all components are hit in almost every text; else twice that
    limit = np.where(total > 0, m * (np.log(m) + 4) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        best, value = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
        use = todo[doc]
        d0, e0, w0 = doc[use], element[use], weight[use]
        level = 0
        while len(d0):
            low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            some = w0 > low
            d0, e0, w0 = d0[some], e0[some], w0[some]
            d, w = d0, w0
            state = mix(e0 + U((level + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
            time = np.zeros(len(d))
            while len(d):
                state = mix(state + U(0x632BE59BD9B4E019))
                time = time - np.log(_unit(state)) / width
                on = time < limit[d]
                d, w, state, time = d[on], w[on], state[on], time[on]
                point = mix(state ^ U(0xD6E8FEB86659FD93))
                inside = np.ones(len(d), bool) if width == 1 else low + _unit(point) * width <= w
                at = d[inside] * m + (mix(point + U(1))[inside] % U(m)).astype(np.int64)
                t, p = time[inside], point[inside]
                order = np.lexsort((t, at))
                at, t, p = at[order], t[order], p[order]
                first = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
                at, t, p = at[first], t[first], p[first]
                less = t < best[at]
                best[at[less]], value[at[less]] = t[less], p[less]
            level += 1
        full = np.isfinite(best.reshape(n_docs, m)).all(1) & todo
        sig[full] = value.reshape(n_docs, m)[full]
        todo &= ~full
        limit = limit * 2
    return sig


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two multisets (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def _sketch(size: int, bands: int, rows: int, block: int = 2 << 20):
    """Per row: doc_id, text digest, two hashes of the word sequence, band hashes (null for a text without words)."""
    names = ["doc_id", "item", "k1", "k2", "bands"]

    def some(ids: list, digests: list, texts: list[bytes]) -> pa.RecordBatch:
        t, doc, h, w = bags(texts, size)
        sig = bagminhash(doc, h, w, t.n_docs, bands * rows)
        band = np.zeros((t.n_docs, bands), np.uint64)
        for r in range(rows):
            band = mix(band * U(3) + sig.reshape(t.n_docs, bands, rows)[:, :, r])
        edge = np.concatenate(([0], np.cumsum(t.count)))
        # two sequence hashes: sums of mixed word hashes times powers, exact for equal sequences only
        pos = np.arange(len(t.hash)) - edge[:-1][t.doc] if len(t.hash) else np.zeros(0, np.int64)
        keys = []
        for salt in (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)):
            part = np.concatenate(([U(0)], np.cumsum(mix(t.hash ^ mix(pos.astype(np.uint64) * salt + salt)), dtype=np.uint64)))
            keys.append((part[edge[1:]] - part[edge[:-1]]).view(np.int64))
        some_words = t.count > 0
        band = band.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), pa.array([list(b) if s else None for b, s in zip(band, some_words, strict=True)], pa.list_(pa.int64()))], names=names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, texts, held = [], [], [], 0
        for b in batches:
            for doc, digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append(doc)
                digests.append(digest)
                texts.append((text.as_py() or "").encode())
                held += len(texts[-1]) + 16
                if held >= block:
                    yield some(ids, digests, texts)
                    ids, digests, texts, held = [], [], [], 0
        if ids:
            yield some(ids, digests, texts)

    return stream


def _verify(size: int):
    """Similarity of pairs (ids a, b) whose digests and texts stand beside them; the last left bag is kept."""

    def bag(text):
        _, _, h, w = bags([text.encode()], size)
        return h, w

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            out = []
            for x, at, bt in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if x != last:
                    last, left = x, bag(at.as_py())
                out.append(overlap(left, bag(bt.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "sim"])

    return stream


def _elements(size: int):
    """The windows of each item with their number; the k-th occurrence of a window is an element of its own."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_numpy()
            for at in range(0, len(items), 64):
                own = items[at : at + 64]
                texts = [t.as_py().encode() for t in batch.column(1)[at : at + 64]]
                _, doc, h, w = bags(texts, size)
                first = np.cumsum(w) - w
                nth = np.arange(w.sum()) - np.repeat(first, w)
                element = mix(np.repeat(h, w) + nth.astype(np.uint64) * U(0x9E3779B97F4A7C15))
                of = np.repeat(doc, w)
                n = np.bincount(of, minlength=len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[of]), pa.array(element.view(np.int64)), pa.array(n[of])], names=["item", "element", "n"])

    return stream


def _apart(mates: DataFrame, pool: DataFrame, size: int, threshold: float) -> DataFrame:
    """``a, b``: pairs of items of a bucket that their rarest elements don't rule out.

    ``mates (item, root, band, value, apart)`` are the members of buckets with several roots; one of
    a pair is ``apart`` from its bucket's commonest root. Let x have n elements, rarest first. Its
    partner y may lack n - need of them, where need is the overlap that ``threshold`` asks for. So of
    x's first ceil(n / 4) no more than that are missing among y's first ``reach``.
    """
    own = shared.written(pool.join(mates.select("item").distinct(), "item").select("item", "text").mapInArrow(_elements(size), "item long, element long, n long"), "elements")
    often = own.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(1)), "element")
    ranked = own.join(often, "element", "left").withColumn("pos", F.row_number().over(order))
    head, reach = F.ceil(F.col("n") / 4), F.ceil(F.col("n") / (4 * threshold) + (1 - threshold) * F.col("n")) + 1
    # (elements of one text alone are always lacking; e is the low half of an element)
    ranked = ranked.where((F.col("pos") <= reach) & F.col("df").isNotNull()).withColumn("e", F.expr("cast(element & 2147483647 as int)"))
    first = F.col("pos") <= head
    bit = F.expr("shiftleft(1L, cast(e & 63 as int))")
    masks = [F.coalesce(F.bit_or(F.when(c & (F.shiftright("e", 6).bitwiseAND(3) == k), bit)), F.lit(0).cast("long")).alias(f"{name}{k}") for name, c in (("h", first), ("r", F.lit(True))) for k in range(4)]
    heads = ranked.groupBy("item").agg(F.first("n").alias("n"), F.collect_set(F.when(first, F.col("e"))).alias("h"), F.collect_set("e").alias("r"), *masks)
    mates = mates.join(heads, "item")
    x = mates.where("apart").select("band", "value", *[F.col(c).alias(f"x_{c}") for c in ("item", "root", "n", "h", "h0", "h1", "h2", "h3")])
    y = mates.select("band", "value", *[F.col(c).alias(f"y_{c}") for c in ("item", "root", "n", "r", "r0", "r1", "r2", "r3")])
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    spare = F.col("x_n") - need - F.ceil(F.col("x_n") / 4) + F.size("x_h")  # of the listed ones, so many may be missing
    missing = sum((F.bit_count(F.col(f"x_h{k}").bitwiseAND(F.bitwise_not(F.col(f"y_r{k}")))) for k in range(1, 4)), F.bit_count(F.col("x_h0").bitwiseAND(F.bitwise_not(F.col("y_r0")))))
    may = (F.col("x_root") != F.col("y_root")) & (need <= F.least("x_n", "y_n")) & (missing <= spare)
    may = may & (F.size("x_h") - F.size(F.array_intersect("x_h", "y_r")) <= spare)
    return x.join(y, ["band", "value"]).where(may).select(F.least("x_item", "y_item").alias("a"), F.greatest("x_item", "y_item").alias("b")).distinct()


@shared.tidied
def near_dups(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """``doc_id, class_id``: one row a document; documents of one class are near or exact copies."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a text digest names an item; equal digests of different texts only mean a needless comparison
    texts = texts.select("doc_id", F.xxhash64("text").alias("item"), "text")
    sketch = shared.written(texts.mapInArrow(_sketch(size, bands, rows), "doc_id long, item long, k1 long, k2 long, bands array<long>"), "sketch")
    told = sketch.where("bands is not null and doc_id is not null")
    # one item for each word sequence (written, so that a hot group's side of the join is an exchange
    # of its own that Spark can split)
    first = shared.written(told.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "item")).alias("r")).select("k1", "k2", F.col("r.doc_id").alias("rep"), F.col("r.item").alias("rep_item")), "reps")
    own = (F.col("doc_id") == F.col("rep")) & (F.col("item") == F.col("rep_item"))
    member = shared.written(told.join(first, ["k1", "k2"]).select("doc_id", "rep", "item", F.when(own, F.col("bands")).alias("bands")), "members")
    entries = member.where("bands is not null").select("item", "rep", F.posexplode("bands").alias("band", "value"))
    buckets = entries.groupBy("band", "value").agg(F.count("*").alias("c"), F.min("item").alias("low"), F.max("item").alias("high")).where("low < high")
    shared_bands = shared.written(entries.join(buckets.drop("low", "high"), ["band", "value"]), "buckets")
    # texts of items that share a band at all, moved once; the same join at every size
    some = shared_bands.groupBy("item", F.col("rep").alias("doc_id")).agg(F.sum("c").alias("met"))
    pool = texts.join(some.hint("merge"), ["item", "doc_id"]).groupBy("item", "doc_id", "met").agg(F.first("text").alias("text"))
    pool = shared.written(pool.select("item", F.col("doc_id").alias("rep"), "met", "text"), "texts")
    met = shared_bands.drop("c").join(pool.select("item", "met"), "item")
    pivots = met.groupBy("band", "value").agg(F.max(F.struct("met", "item")).alias("p"), F.min(F.struct("rep", "item")).alias("q")).select("band", "value", F.col("p.item").alias("p1"), F.col("q.item").alias("p2"))

    def linked(pairs: DataFrame) -> DataFrame:
        """``a, b``: ids of the pairs of items (a, b) that are similar."""
        left, right = (pool.select(F.col("item").alias(c), F.col("rep").alias(f"{c}_rep"), F.col("text").alias(f"{c}_text")) for c in "ab")
        both = pairs.join(left, "a").join(right, "b").where("a_rep <> b_rep")
        judged = both.select("a_rep", "b_rep", "a", "a_text", "b_text").mapInArrow(_verify(size), "a long, b long, sim double")
        return shared.written(judged.where(F.col("sim") >= threshold).select("a", "b"), "links")

    stars = shared_bands.join(pivots, ["band", "value"]).select("item", F.explode(F.array("p1", "p2")).alias("p")).where("item <> p")
    links = linked(stars.select(F.least("item", "p").alias("a"), F.greatest("item", "p").alias("b")).distinct())
    # all texts of a repeated doc_id are of one class
    repeated = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").drop("most")
    links = links.union(member.join(repeated, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")))
    roots = components(links)
    # members of buckets that are still in several components
    placed = shared_bands.select("item", "rep", "band", "value").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("item", F.coalesce("root", "rep").alias("root"), "band", "value")
    placed = shared.written(placed, "placed")
    sizes = placed.groupBy("band", "value", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("band", "value").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    mixed = mixed.select("band", "value", F.col("most.root").alias("main"))
    mates = shared.written(placed.join(mixed, ["band", "value"]).withColumn("apart", F.col("root") != F.col("main")).drop("main"), "mates")
    if shared.some(mates):
        late = linked(_apart(mates, pool, size, threshold))
        if shared.some(late):
            at = roots.select("id", F.col("root").alias("old"))
            known = late.join(at.select(F.col("id").alias("a"), F.col("old").alias("x")), "a", "left").join(at.select(F.col("id").alias("b"), F.col("old").alias("y")), "b", "left")
            moved = components(known.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
            old = at.unionByName(moved.select("id", F.col("id").alias("old")).join(at.select("id"), "id", "left_anti"))
            roots = old.join(moved.select(F.col("id").alias("old"), "root"), "old", "left").select("id", F.coalesce("root", "old").alias("root"))
    classes = member.select("doc_id", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    return classes.unionByName(sketch.where("bands is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the smallest ``doc_id`` of their class (and those without a ``doc_id``)."""
    keep = near_dups(docs, **options).where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    keep = shared.written(keep.select(F.col("doc_id").alias("kept_id"), "n"), "kept")
    key = shared.free_name(docs, "kept_id")
    keep = keep.withColumnRenamed("kept_id", key)
    kept = docs.join(keep.select(key), docs["doc_id"].cast("long") == F.col(key), "left_semi")
    if not keep.where("n > 1").isEmpty():  # rows that repeat a kept id are copies too
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dups(shared.table(spark, sf_dir, "documents"))
