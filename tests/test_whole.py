"""Queries cover every row of their tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentra.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def embeddings(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas().sort_values("vec_id")
    return e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)


@pytest.mark.parametrize("name, column, table, source", [
    ("scan_detections", "frame", "lineitem", "l_orderkey"), ("classify_error", "event_id", "events", "event_id"), ("parse_trake_events", "conv_id", "conversations", "conv_id"),
    ("reranker_provider_api", "query_id", "benchmark", "item_id"), ("reranker_provider_api", "item_id", "benchmark", "item_id"),
])
def test_every_id_is_there(spark, name, column, table, source):
    ours = QUERIES[name](spark, FOLDER).select(F.col(column).cast("long").alias("id")).distinct()
    all_ids = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(F.col(source).cast("long").alias("id")).distinct()
    assert {r["id"] for r in ours.collect()} == {r["id"] for r in all_ids.collect()}


@pytest.mark.parametrize("name", ["match_hashes_monotonic", "rebuild_map"])
def test_every_video_is_there(spark, name):
    from momentra.sources.tables import Tables

    ours = {r["video_id"] for r in QUERIES[name](spark, FOLDER).select("video_id").collect()}
    assert ours == {r["video_id"] for r in Tables(spark, FOLDER).catalog.select("video_id").collect()}


def _hashes(ids, modulus=None):
    return [int(hashlib.md5(str(i % modulus if modulus else i).encode()).hexdigest()[:15], 16) for i in ids.tolist()]


def test_near_dups_against_all_pairs(spark, embeddings):
    ids, h = embeddings[0].tolist(), _hashes(embeddings[0], 40)
    first = {}
    for i, x in zip(ids, h):
        first.setdefault(x, i)
    want = {(first[x], i) for i, x in zip(ids, h) if first[x] != i} | {(a, b) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 5}
    got = [tuple(r) for r in QUERIES["dhash_near_dup"](spark, FOLDER).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_losses_of_all_rows(spark, embeddings):
    ids, every = embeddings
    got = {r["batch"]: r for r in QUERIES["pairwise_losses"](spark, FOLDER).collect()}
    assert set(got) == set((ids // 32).tolist())
    for batch, r in got.items():
        x = every[ids // 32 == batch]
        s, n = x @ (x + 0.1).T, len(x)
        own, e = np.diag(s), np.exp(10 * s)
        want = [np.log1p(np.exp(-np.where(np.eye(n) > 0, 1, -1) * (10 * s - 5))).sum() / n, ((np.log(e.sum(1)) + np.log(e.sum(0))) / 2 - 10 * own).mean(), (1 - own).mean()]
        assert [r["sigmoid"], r["contrastive"], r["distill"]] == pytest.approx(want, abs=2e-6)


def test_normalize_answer_takes_whole_texts(spark):
    from momentra.functions import text

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = spark.createDataFrame([*docs.items()], "doc_id long, text string").select("doc_id", text.normalize_answer(F.col("text")).alias("answer"))
    got = {r["doc_id"]: r["answer"] for r in QUERIES["normalize_answer"](spark, FOLDER).collect()}
    assert got == {r["doc_id"]: r["answer"] for r in want.collect()} and max(map(len, got.values())) > 1000


def test_ocr_context_joins_whole_texts(spark, tmp_path):
    long = "x" * 40
    texts = [long + " one", long + " two", "short", long + " one", "y" * 700]  # equal in their first 30 characters, one repeat
    spark.createDataFrame([(i, [1.0], 0) for i in range(5)], "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: " | ".join(dict.fromkeys(texts[max(0, i - 2) : i + 3]))[:600] for i in range(5)}
    assert {r["global_id"]: r["context"] for r in QUERIES["ocr_context"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", ["knn_cross_join", "dense_topk", "nearest", "ann_topk_ivf", "ann_topk_hnsw"])
def test_every_fiftieth_row_asks(spark, embeddings, name):
    ids, x = embeddings
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert set(got.query_id) == {i for i in ids.tolist() if i % 50 == 0}
    want = dict(zip(ids.tolist(), x, strict=True))
    assert np.allclose(got.score, [want[q] @ want[i] for q, i in zip(got.query_id, got.global_id, strict=True)], atol=1e-6)
    if name == "knn_cross_join":
        assert len(got) == len(ids) * len(set(got.query_id))


def test_every_text_asks(spark):
    items = {r["item_id"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    assert {r["query_id"] for r in QUERIES["embedding_provider_api"](spark, FOLDER).collect()} == items
    assert {r["query_id"] for r in QUERIES["bm25_score"](spark, FOLDER).collect()} > set(range(8))
