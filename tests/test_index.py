"""Indexes on disk, whole-table replacement and the sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentra.operators import bm25
from momentra.operators.index import GraphIndex, StaleIndex, TextIndex, VectorIndex
from momentra.plans import registry
from momentra.sources import files, store
from momentra.sources.tables import Tables

from .conftest import frame

FOLDER = "/root/testdata/sf0.001"


def _docs(spark, texts):
    return frame(spark, [(i, 0, t) for i, t in enumerate(texts)], "key long, doc_no int, text string")


def test_text_index_is_stored_signed_and_refused(spark, tmp_path):
    path = f"{tmp_path}/text"
    docs = _docs(spark, ["red door", "blue door by a red wall", None, "", "wall wall"])
    asked = frame(spark, [(0, "red wall"), (1, "nothing here"), (2, "door door")], "query_id long, text string")
    with pytest.raises(StaleIndex):
        TextIndex.open(docs, path)
    TextIndex.build(docs, path)
    index = TextIndex.open(docs.repartition(3), path)  # the order of rows does not matter
    want = {(r["query_id"], r["key"]): round(r["score"], 9) for r in bm25.score(docs, asked).collect()}
    assert {(r["query_id"], r["key"]): round(r["score"], 9) for r in index.score(asked).collect()} == want and want
    some = frame(spark, [(0, 1), (2, 0)], "query_id long, key long")
    assert {(r["query_id"], r["key"]) for r in index.score(asked, some).collect()} == {(0, 1), (2, 0)}
    changed = _docs(spark, ["red door", "blue door by a red wall", None, "", "wall wall wall"])
    with pytest.raises(StaleIndex):
        TextIndex.open(changed, path)
    assert TextIndex.ensure(changed, path).table("postings").where("token = 'wall' and tf = 3").count() == 1
    store.drop(spark, f"{path}/signature")  # as after a writer that was lost
    with pytest.raises(StaleIndex):
        TextIndex.open(changed, path)


def test_text_index_reads_its_tokens_parts_only(spark, tmp_path):
    docs = _docs(spark, [f"word{i} word{i + 1}" for i in range(200)])
    index = TextIndex.build(docs, f"{tmp_path}/text")
    plan = index.score(frame(spark, [(0, "word7")], "query_id long, text string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 16))
    x = np.array([centers[i % 8] + 0.3 * rng.normal(size=16) for i in range(900)])
    x /= np.sqrt((x**2).sum(1))[:, None]
    v = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "global_id long, v array<double>")
    return x, v, v.where("global_id % 50 = 0").select(F.col("global_id").alias("query_id"), F.col("v").alias("qv"))


@pytest.mark.parametrize("kind, settings, options", [(VectorIndex, {"cells": 8}, {"probes": 4}), (GraphIndex, {"block": 4096, "m": 12}, {}), (GraphIndex, {"block": 200, "m": 8}, {"together": 3})])
def test_vector_indexes(spark, tmp_path, cloud, kind, settings, options):
    x, v, q = cloud
    kind.build(v, f"{tmp_path}/index", **settings)
    got: dict = {}
    for r in kind.open(v, f"{tmp_path}/index", **settings).search(q, 10, **options).collect():
        got.setdefault(r["query_id"], {})[r["global_id"]] = r["score"]
    assert set(got) == set(range(0, 900, 50)) and all(len(g) == 10 for g in got.values())
    assert all(s == pytest.approx(x[i] @ x[j]) for i, g in got.items() for j, s in g.items())
    assert np.mean([len(set(np.argsort(-(x @ x[i]))[:10].tolist()) & set(g)) / 10 for i, g in got.items()]) >= 0.9
    with pytest.raises(StaleIndex):
        kind.open(v, f"{tmp_path}/index", **(settings | {next(iter(settings)): 5}))
    with pytest.raises(StaleIndex):
        kind.open(v.where("global_id > 0"), f"{tmp_path}/index", **settings)


def test_graph_search_of_the_test_table_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    got: dict = {}
    for r in registry.queries()["ann_topk_hnsw"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], set()).add(r["global_id"])
    recall = [len(set(ids[np.argsort(-(x @ x[ids == q][0]), kind="stable")[:10]].tolist()) & g) / 10 for q, g in got.items()]
    assert len(recall) == (ids % 50 == 0).sum() and np.mean(recall) >= 0.9


def test_publish_replaces_whole_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert store.current(spark, path) is None
    store.publish(spark.range(5), path)
    first = store.current(spark, path)
    with pytest.raises(Exception, match="broken"):
        store.publish(spark.range(9).select(F.when(F.col("id") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), path)
    assert store.current(spark, path) == first and store.read(spark, path).count() == 5
    store.publish(spark.range(7), path)
    assert store.read(spark, path).count() == 7 and not store.exists(spark, f"{path}/{first}")


def test_signatures_tell_content_not_order(spark):
    a = frame(spark, [(1, "x"), (2, None), (2, None)], "k long, t string")
    assert store.signature(a) == store.signature(a.orderBy(F.desc("k")).repartition(2)) != store.signature(a.distinct())
    assert store.signature(a, 1) != store.signature(a, 2)


def test_map_files_round_trip_and_refuse_negative_frames(spark, tmp_path):
    maps = Tables(spark, FOLDER).catalog
    files.write_map_csv(maps, f"{tmp_path}/maps")
    back = files.read_maps(spark, f"{tmp_path}/maps")
    columns = ["video_id", "n", "pts_time", "fps", "frame_idx"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, maps.select(columns).collect()))
    with pytest.raises(ValueError, match="negative"):
        files.write_map_csv(maps.withColumn("frame_idx", F.lit(-1)), f"{tmp_path}/none")
    assert not store.exists(spark, f"{tmp_path}/none")
