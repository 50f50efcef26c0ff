"""The pipeline against its stages' brute-force versions, and its contract."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from momentra.llm import mixing, quality, registry

from .test_llm import SPACE, _bags, _classes, _substring_truth

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _drawn(docs):
    """Ids that the mixing stage should draw, by raking in pandas."""
    d = docs.fillna({"source": "", "lang": "", "text": ""})
    low = d.text.str.lower()
    counts = np.array([[sum(p in t for p in phrases) for _, phrases in mixing.TOPICS] for t in low])
    d["topic"] = [mixing.TOPICS[c.argmax()][0] if c.max() else "prose" for c in counts]
    d["n"] = [len(SPACE.findall(t)) for t in d.text]
    cells = d.groupby(["source", "lang", "topic"]).n.sum().reset_index()
    total = cells.n.sum()
    goals = {}
    for name in ("source", "lang", "topic"):
        own = cells.groupby(name).n.sum() / total
        stated = mixing.TARGETS.get(name, {})
        raw = own.copy() if stated else own**0.8
        raw.update({k: v for k, v in stated.items() if k in own})
        goals[name] = raw / raw.sum() * total
    cells["f"] = cells.n.astype(float)
    for _ in range(60):
        for name, goal in goals.items():
            cells["f"] *= cells[name].map(goal) / cells.groupby(name).f.transform("sum")
    ratio = (cells.f / cells.n).fillna(0)
    cells["p"] = (ratio / ratio.max()).round(9)
    p = d.merge(cells[["source", "lang", "topic", "p"]], on=["source", "lang", "topic"]).set_index("doc_id").p
    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52  # noqa: E731, S324
    return sorted(i for i, q in p.items() if draw(i) < q)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{len(seen)}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == COLUMNS
        seen[name] = (before.toPandas(), docs.toPandas())
    start, kept = seen["quality rules"]
    verdict = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(start), F.col("doc_id")).withColumnRenamed("row", "doc_id").collect()}
    assert sorted(kept.doc_id) == sorted(d for d, k in verdict.items() if k)
    start, kept = seen["minhash near-dedup"]
    classes = _classes(_bags(zip(start.doc_id, start.text, strict=True)))
    assert sorted(kept.doc_id) == sorted({*classes.values()})
    start, kept = seen["substring dedup"]
    truth = {d: (n, gone) for d, n, gone, _ in _substring_truth([*zip(start.doc_id, start.text, strict=True)])}
    assert sorted(kept.doc_id) == sorted(d for d, (n, gone) in truth.items() if n > gone)
    assert all(len(t.split()) == truth[d][0] - truth[d][1] for d, t in zip(kept.doc_id, kept.text, strict=True))
    assert (kept.n_chars == kept.text.str.len()).all()
    start, kept = seen["mixing"]
    assert sorted(kept.doc_id) == _drawn(start) and 0 < len(kept) <= len(start)
    start, pieces = seen["packing"]
    assert set(pieces.doc_id) == set(start.doc_id)
    assert np.array_equal(pieces.groupby("doc_id").length.sum(), pieces.groupby("doc_id").doc_tokens.first())


def test_run_and_registry(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and out.agg(F.max("length")).first()[0] <= 2048
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pipeline_rows_without_id_pass(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "s", 5), (1, "d e f", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.substring_dedup_stage(spark, docs, FOLDER)
    assert out.columns == COLUMNS and out.count() == 2
