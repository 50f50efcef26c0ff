"""What only tables beyond the smallest scale show: long batch names, copies, searches in several tiles."""

import random
from pathlib import Path

import numpy as np
import pytest

from momentra.operators import bm25, exact, index
from momentra.plans import registry

from .oracle import connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Rows on both sides of the hundredth batch; every third vector is a copy of its neighbour."""
    folder, rng = tmp_path_factory.mktemp("late"), np.random.default_rng(3)
    x = rng.normal(size=(260, 64))
    x[0:258:3] = x[1:259:3]
    rows = [(19_700 + i, (v / np.linalg.norm(v)).tolist(), i % 10) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).toPandas().to_parquet(folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["build_manifest", "write_qa", "write_trake", "write_kis"])
def test_batches_beyond_99(spark, late, name):
    ours, theirs = same(QUERIES[name](spark, late), connect(late), SQL[name])
    assert ours == theirs and any("L100_" in str(r) for r in ours) == (name != "write_kis")


@pytest.mark.parametrize("name", ["rocchio", "context_boost", "answer_variant_rows", "build_plan", "tune_weights", "dense_topk"])
def test_copies_and_late_ids(spark, late, name):
    ours, theirs = same(QUERIES[name](spark, late), connect(late), SQL[name])
    assert ours == theirs and ours


def _brute(rows, asked, k):
    """Best rows by plain sums, component after component; null scores last, no number first."""

    def score(q, v):
        if q is None or v is None or len(q) != len(v) or None in v or None in q:
            return None
        s = 0.0
        for a, b in zip(q, v, strict=True):
            s += a * b
        return s

    def place(r):
        s = r[1]
        return (2, 0.0, r[0]) if s is None else (0, 0.0, r[0]) if s != s else (1, -s, r[0])

    return {q: sorted(((i, score(qv, v)) for i, v in rows), key=place)[:k] for q, qv in asked}


@pytest.mark.parametrize("copies, block, chunk", [(1, 4096, 8192), (1, 3, 16), (40, 4, 32), (400, 2, 64)])
def test_best_against_brute_force(spark, copies, block, chunk):
    rng = random.Random(copies)
    pool = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(max(2, 400 // copies))]
    rows = [(i, pool[rng.randrange(len(pool))]) for i in range(400)]
    rows[7] = (7, None)
    rows[8] = (8, [0.0] * 8)
    rows[9] = (9, [1.0] * 7 + [None])
    rows[10] = (10, [1.0] * 7 + [float("inf")])
    rows[11] = (11, [float("nan")] * 8)
    asked = [(i, v) for i, v in rows if i % 50 == 0 or i in (7, 8, 10)]
    df = spark.createDataFrame(rows, "global_id long, v array<double>")
    some = spark.createDataFrame(asked, "query_id long, qv array<double>")
    got: dict = {}
    for r in exact.best(df, some, 20, (400, len(asked)), block, chunk).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["global_id"], r["score"]))
    want = _brute(rows, asked, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert repr(got[q]) == repr(want[q])


def test_vectors_too_short_to_square():
    """Copies that come after rows of larger ids take their places; those of very short queries were lost by rounding."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 33))[rng.integers(0, 50, 600)]
    x[:40] *= 1e-200
    tile = exact._Tile(np.arange(40), x[:40], np.ones(40, bool), 5)
    for a in reversed(range(0, 600, 16)):
        z = min(a + 16, 600)
        tile.add(np.arange(a, z), x[a:z], np.ones(z - a, bool))
    found = np.concatenate([b["global_id"] for b in tile.found()]).reshape(40, 5)
    score = sum((x[:40, None, i] * x[None, :, i] for i in range(33)), np.zeros((40, 600)))
    assert np.array_equal(found, np.argsort(-score, axis=1, kind="stable")[:, :5])


def test_few_pairs_are_looked_at_twice():
    """Beyond the first rows, a product in single precision leaves few pairs; no group of queries is merged for each part of the rows."""
    x = np.random.default_rng(4).normal(size=(33_000, 16))
    tile, looked, merged = exact._Tile(np.arange(256), x[:256], np.ones(256, bool), 10), [], []
    nearest, merge = tile._nearest, tile._merge
    tile._nearest = lambda some, *rest: (looked.append(len(some)), nearest(some, *rest))[1]
    tile._merge = lambda a: (merged.append(a), merge(a))[1]
    for a in range(0, 33_000, 1000):
        tile.add(np.arange(a, a + 1000), x[a : a + 1000], np.ones(1000, bool))
    found = [b.to_pydict() for b in tile.found()]
    assert sum(looked) < 2 * 256 and len(merged) < 33
    score = sum((x[:256, None, i] * x[None, :, i] for i in range(16)), np.zeros((256, 33_000)))
    assert np.array_equal(np.concatenate([f["global_id"] for f in found]).reshape(256, 10), np.argsort(-score, axis=1, kind="stable")[:, :10])


def test_a_lane_is_searched_once(spark, late):
    """Queries that read a lane several times share one search; no plan holds pairs of rows."""
    for name in ("query_confidence", "neighbor_boost", "context_boost"):
        plan = QUERIES[name](spark, late)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "MapInArrow" not in plan


def test_candidates_are_scored_without_an_index(spark, monkeypatch):
    """fuse_signals scores its candidates' texts from one pass of counts; it used to index every text first."""
    monkeypatch.setattr(index.TextIndex, "ensure", lambda *a, **k: pytest.fail("an index is built"))
    name, folder = "fuse_signals", "/root/testdata/sf0.001"
    ours, theirs = same(QUERIES[name](spark, folder), connect(folder), SQL[name])
    assert ours == theirs and ours


@pytest.mark.parametrize("again", [False, True])
def test_candidate_scores_are_those_of_all(spark, again):
    """Empty and null texts count nowhere; rows of a repeated document count as one, as they do without candidates."""
    texts = ["red car", "a red red bus", "", None, "Blue CAR, blue sky", "sky", "...", "đường phố red"]
    docs = [(i % 5, i, x) for i, x in enumerate(texts)] + [(1, 1, "a red red bus")] * again
    docs = spark.createDataFrame(docs, "key long, doc_no int, text string")
    asked = spark.createDataFrame([(0, "red car red"), (1, "duong sky"), (2, ""), (9, "bus")], "query_id long, text string")
    pairs = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (0, 3), (1, 0), (1, 2), (2, 1), (3, 1), (9, 77)], "query_id long, key long")
    read = lambda df: sorted((r["query_id"], r["key"], round(r["score"], 12)) for r in df.collect())
    every = read(bm25.score(docs, asked).join(pairs.distinct(), ["query_id", "key"]))
    assert read(bm25.score(docs, asked, pairs)) == every and len(every) >= 4


def test_a_text_is_parted_once(spark):
    """No filter on tokens: it would part every text a second time."""
    docs = spark.createDataFrame([(1, 0, "a b")], "key long, doc_no int, text string")
    plan = bm25.postings(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_trials_are_not_dealt_out(spark, late):
    """tune_weights multiplies by its 25 trials after its only exchange of rows."""
    plan = QUERIES["tune_weights"](spark, late)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "hashpartitioning(trial" in plan and "hashpartitioning(query_id" in plan


@pytest.mark.parametrize("name", ["caption_step_signal", "low_confidence_retry", "minmax", "monotonize", "neighbor_offset_join", "qa_hedge_rows", "qualifier_score", "run_diff_full_outer", "scan_signal_dumps", "select_weak", "video_concentration", "vlm_rerank"])
def test_no_pairs_in_the_plan(spark, late, name):
    """These queries read their lanes from the searched tables; their plans held all pairs of rows before."""
    plan = QUERIES[name](spark, late)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("name, key", [("write_kis", "query_id"), ("write_map_csv", "video_id")])
def test_folders_are_written_by_all_cores(spark, late, name, key):
    """The rows are few bytes, which Spark joins into one task; that task used to write every folder."""
    shared, old = Path(spark.conf.get("spark.checkpoint.dir")), set()
    old.update(shared.iterdir())
    QUERIES[name](spark, late)
    (new,) = [d for d in set(shared.iterdir()) - old if not d.name.startswith("lane-top")]
    writers = [{f.name.split("-")[1] for f in d.glob("part-*")} for d in new.glob(f"{key}=*")]
    assert len(writers) > 5 and all(len(w) == 1 for w in writers) and len(set.union(*writers)) > 1
