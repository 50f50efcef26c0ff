"""The ten operators against SQL, brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import pathlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentra.llm import ann, chat, components, hashing, license_scan, mixing, near_dedup, packing, quality, registry, sharding, shared, substring_dedup, toxicity
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def P(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    ours, theirs = same(registry.QUERIES[name](spark, FOLDER), connect(FOLDER), registry.ORACLE_SQL[name])
    assert ours == theirs and ours


#: Nulls, blanks, repeats, one word, odd white space, other scripts, a long text.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "no id at all here"), (5, "a\x0bb\x0cc\xa0d \u2003e"), (6, "naïve café \U0001f600 Straße"), (7, "x y z " * 5000), (8, "same text " * 30), (9, "same text " * 30)]
CLASHING = "doc_id long, text string, n_words string, kept string, kept_id string, band string, low string, m_source string, lang string, source string, key string, score string"


def odd(spark):
    return frame(spark, [(*r, "n", "k", "i", "b", "l", "m", None, "s", "y", "z") for r in ODD], CLASHING)


# -- hashing ----------------------------------------------------------------------------------
def test_words_and_windows_depend_on_words_only():
    a = hashing.Texts([b"one two  three", b"", b"\tone two\nthree four "])
    assert a.count.tolist() == [3, 0, 4]
    h, at = a.windows(3)
    assert at.tolist() == [0, 3, 4] and h[0] == h[1] != h[2]
    assert len(set(hashing.words(" ".join(f"w{i}" for i in range(50_000)).encode())[2].tolist())) == 50_000


def test_hashes_do_not_depend_on_segments(monkeypatch):
    text = (" ".join(f"w{i % 977}" for i in range(20_000))).encode()
    want = hashing.words(text)[2]
    monkeypatch.setattr(hashing, "_SEGMENT", 1000)
    assert (hashing.words(text)[2] == want).all()


# -- 1 licences -------------------------------------------------------------------------------
def test_license_scan(spark):
    mit = license_scan.LICENSES[2][1]
    changed = "Copyright (c) 2001 Somebody\n" + mit.replace("sublicense", "sub-license").upper().replace(", ", " ,\n")
    rows = [(1, mit), (2, changed), (3, "Some prose.\nreleased under the  MIT licence\nmore\nSPDX-License-Identifier: MIT"), (4, None), (4, None), (5, mit + " extra")]
    got = sorted((r["doc_id"], r["text_license"], r["line_licenses"], r["n_license_lines"]) for r in license_scan.scan(frame(spark, rows)).collect())
    assert got[0][:2] == (1, "MIT") and got[1][:2] == (2, "MIT")
    assert got[2] == (3, None, "MIT", 2) and got[3] == got[4] == (4, None, "", 0) and got[5][1] is None
    assert license_scan.scan(odd(spark)).count() == len(ODD) and license_scan.scan(odd(spark).limit(0)).count() == 0


def test_license_rows_of_one_id_stay_apart(spark):
    text = "foo\nReleased under the MIT License.\nbar"
    rows = [(1, text), (1, text.replace("\n", " ")), (None, text), (None, "x"), (1, text)]
    got = sorted(((r["doc_id"], r["line_licenses"], r["n_license_lines"]) for r in license_scan.scan(frame(spark, rows)).collect()), key=str)
    assert got == [(1, "", 0), (1, "MIT", 1), (1, "MIT", 1), (None, "", 0), (None, "MIT", 1)]


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0")])
def test_entire_licenses(spark, file, name):
    path = pathlib.Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("no such text here")
    assert license_scan.scan(frame(spark, [(1, path.read_text())])).first()["text_license"] == name


def test_wrapped_license_keeps_its_words(spark):
    bsd = next(t for n, t in license_scan.LICENSES if n == "BSD-3-Clause")
    head = "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n"
    rows = [(1, head + bsd.replace(" copyright notice", "\ncopyright notice")), (2, "Copyright 2020 A\n(c) 2021 B\n© C\n" + bsd), (3, head + "(c) You must retain " + bsd)]
    got = {r["doc_id"]: r["text_license"] for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: None}


# -- 2 packing --------------------------------------------------------------------------------
def _pack(df, **o):
    return packing.pack(df, P("byte_bpe_50k.json"), P("byte_bpe_50k.tiktoken"), **o)


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P("byte_bpe_50k.json"))
    texts = dict(zip(documents.doc_id, documents.text, strict=True)) | {-1: None, -2: "", -3: "日本語 <|endoftext|> \U0001f600 ẞ", -4: " a " * 3000, -5: "a <|endoftext|> b<|endoftext|>"}
    df = frame(spark, [(int(k), v) for k, v in texts.items()])
    p = _pack(df).toPandas()
    for doc, own in p.sort_values("start").groupby("doc_id"):
        ids = [*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids
        assert (own.doc_tokens == len(ids)).all() and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert all(zlib.crc32(i) == c for i, c in zip(own.ids, own.ids_crc32, strict=True))
    assert set(p.doc_id) == set(texts)
    for seq, own in p.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert own.length.sum() == 2048 or seq == p.sequence_id.max()


def test_control_strings_as_text():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P("byte_bpe_50k.json"))
    text = "a <|endoftext|> b"
    files = P("byte_bpe_50k.json"), P("byte_bpe_50k.tiktoken")
    assert packing.tokenize(text, *files).tolist() == tok.encode(text, add_special_tokens=False).ids
    tok.encode_special_tokens = True
    assert packing.tokenize(text, *files, control_as_text=True).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_odd_input(spark):
    p = _pack(odd(spark)).toPandas()
    assert p.doc_id.isna().sum() == 1 and (p[p.doc_id == 4].start == 0).sum() == 2
    assert _pack(odd(spark).limit(0)).count() == 0


# -- 3 nearest neighbours ---------------------------------------------------------------------
def test_multi_sequence_walk_is_ordered():
    rng = np.random.default_rng(0)
    left, right = rng.normal(size=6), rng.normal(size=5)
    cells = ann.traverse(left, right, np.ones(30, int), 30)
    cost = [left[c // 5] + right[c % 5] for c in cells]
    assert sorted(cells) == [*range(30)] and cost == sorted(cost)
    assert len(ann.traverse(left, right, np.ones(30, int), 7)) == 7


def _recall(spark, folder):
    out = ann.op3_ann(spark, folder).toPandas()
    e = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    recall = []
    for q, own in out.groupby("query_id"):
        s = ann.exact_scores(x[ids == q], x)[0]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == [*range(1, 21)] and q not in set(own.vec_id)
        assert np.array_equal(own.score, s[np.searchsorted(ids, own.vec_id)])
        want = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        recall.append(len(set(ids[want]) & set(own.vec_id)) / 20)
    assert len(recall) == (ids % 20 == 0).sum()
    return np.mean(recall)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_ann_against_brute_force(spark, folder):
    assert _recall(spark, folder) >= 0.9


def test_ann_tiles_hold_all_cells():
    counts = np.array([3, 0, 25, 4, 4, 4, 10, 1])
    first, parts = ann.tiles(counts, 10)
    assert parts.tolist() == [1, 1, 3, 1, 1, 1, 1, 1] and first.tolist() == [0, 0, 1, 4, 4, 5, 6, 7]


def test_ann_finds_all_whatever_the_tiles(spark):
    x = np.random.default_rng(5).normal(size=(300, 6))
    v = spark.createDataFrame([(i, r.tolist(), "t", "p", 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, tile string, part string, cell long").repartition(3)
    s = ann.exact_scores(x, x)
    for block, together in ((7, 2), (64, 10), (10_000, 1000)):
        got = ann.search(v, F.col("vec_id") % 3 == 0, k=4, centroids=3, visit=1.0, block=block, together=together).toPandas()
        assert len(got) == 400
        for q, own in got.groupby("query_id"):
            assert own.sort_values("rank").vec_id.tolist() == [i for i in np.lexsort((np.arange(300), -s[q])) if i != q][:4]


def test_ann_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [3.0]), (None, [1.0, 1.0]), (7, []), *((i, [2.0, 0.0]) for i in range(20, 60)), (100, [9.0, 9.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(v, F.col("vec_id") % 20 == 0, k=5, centroids=4, visit=1.0, block=7).toPandas()
    assert set(out.query_id) == {0, 20, 40, 100}
    assert out[out.query_id == 0].sort_values("rank").vec_id.tolist() == [100, 20, 21, 22, 23]
    assert out[out.query_id == 20].sort_values("rank").vec_id.tolist() == [100, 21, 22, 23, 24]
    assert ann.search(v.limit(0), F.lit(True)).count() == 0
    assert ann.search(v.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("n, copies", [(5, 1), (21, 1), (30, 1), (30, 9)])
def test_ann_fills_k_on_small_tables(spark, n, copies):
    x = np.random.default_rng(3).normal(size=(n + copies - 1, 8))
    rows = [(max(0, i - copies + 1), v.tolist()) for i, v in enumerate(x)]  # id 0 has so many rows
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(v, F.lit(True), k=20).select("query_id", "vec_id").toPandas()
    others = [(q, sum(i != q for i, _ in rows)) for q in {i for i, _ in rows}]
    assert got.groupby("query_id").size().to_dict() == {q: min(20, m) for q, m in others} and (got.query_id != got.vec_id).all()


# -- 4 mixing ---------------------------------------------------------------------------------
def test_raked_marginals_meet_targets(spark):
    rng = np.random.default_rng(1)
    cells = [(s, lang, t, int(rng.integers(50, 5000))) for s in "ab" for lang in ("en", "fr", "de") for t in ("x", "y")]
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.5, "fr": 0.25, "de": 0.25}, "topic": {"x": 0.5, "y": 0.5}}
    fitted = mixing.fit(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), targets).toPandas()
    total = sum(c[3] for c in cells)
    for name, want in targets.items():
        assert fitted.groupby(name).fitted.sum().div(total).to_dict() == pytest.approx(want, abs=1e-9)


def test_raking_tells_unreachable_targets(spark):
    cells = spark.createDataFrame([("a", "en", "x", 100), ("b", "fr", "x", 300)], "source string, lang string, topic string, tokens long")
    got = mixing.fit(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "fr": 0.1, "de": 7.0}}, rounds=20).toPandas()
    assert got.residual.min() > 0.5  # a is en alone, so its share can't be 0.5 and 0.9
    fine = mixing.fit(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "fr": 0.5}}).toPandas()
    assert fine.residual.max() < 1e-9 and fine.fitted.tolist() == pytest.approx([200, 200])
    many = mixing.fit(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "fr": 0.5}}, small=0).toPandas()
    assert many.sort_values("source").fitted.tolist() == pytest.approx([200, 200])


def test_topic_with_most_phrases_wins(spark):
    texts = ["the court heard of the contract for software", "a server and its database, by contract", "nothing", None, "a | b @ c"]
    got = [r[0] for r in frame(spark, [*enumerate(texts)]).select(mixing.topic_of(F.lower(F.coalesce("text", F.lit(""))))).collect()]
    assert got == ["legal", "technology", "prose", "prose", "table"]


def test_sampled_marginals_meet_stated_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    out = mixing.probabilities(docs, F.col("doc_id")).toPandas()
    out["w"] = out.n_tokens * out.probability
    for name in ("lang", "topic"):
        got = out.groupby(name).w.sum() / out.w.sum()
        stated = mixing.TARGETS[name]
        rest = out[~out[name].isin(stated)].n_tokens.sum() / out.n_tokens.sum()
        for category, share in stated.items():
            assert got[category] == pytest.approx(share / (sum(stated.values()) + rest), rel=0.01)


def test_mixing_odd_input(spark):
    out = mixing.probabilities(odd(spark), F.col("doc_id")).toPandas()
    assert len(out) == len(ODD) and out.probability.between(0, 1).all() and out.probability.max() == 1
    assert mixing.sample(odd(spark)).columns == odd(spark).columns
    assert mixing.sample(odd(spark).limit(0)).count() == 0


# -- 5 substring dedup ------------------------------------------------------------------------
def _substring_truth(rows, size=13):
    first = {}
    words = [(d, SPACE.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"cuts": (0.2, 0.4, 0.6, 0.8), "fan_in": 2, "prefix_bits": 3, "chunk_bytes": 20_000}])
def test_substring_dedup_against_brute_force(spark, documents, options):
    rows = [*zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, f"start{i} {passage} end{i} " + " ".join(f"own{i}_{j}" for j in range(20))) for i in range(12)]
    df = frame(spark, [*rows, *ODD]).repartition(5)
    got = substring_dedup.dedup(df, **options)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == _substring_truth([*rows, *ODD])


def test_substring_index_outlives_a_call(spark, documents, tmp_path):
    rows = sorted(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    half, root = len(rows) // 2, f"{tmp_path}/index"
    substring_dedup.FingerprintIndex.create(spark, root, bits=4, fan_in=2).close()
    got = []
    for part in (rows[:half], rows[half:]):
        got += [tuple(r) for r in substring_dedup.dedup(frame(spark, part), cuts=(0.5,), index=root).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == _substring_truth(rows)
    index = substring_dedup.FingerprintIndex.open(spark, root)
    assert len(index.runs) == 1 and index.runs[0].startswith("2.")  # four batches, compacted twice
    kept = index.read(index.runs).count()
    spark.range(5).select(F.lit(0).alias("prefix"), F.lit(None).cast("long").alias("chunk"), F.lit(b"half a run").alias("keys"), F.lit("0.99").alias("run")).write.insertInto(index.table)
    index.close()
    again = substring_dedup.FingerprintIndex.open(spark, root)  # a run that was never logged is no part of it
    assert again.read(again.runs).count() == kept and spark.table(again.table).count() == kept
    again.close(delete=True)


def test_substring_kept_text_keeps_spacing(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    df = frame(spark, [(1, passage), (2, f"before  it\n{passage}\nafter   it\n")])
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup.dedup(df).collect()}
    assert kept == {1: passage, 2: "before  it\nafter   it\n"}
    assert substring_dedup.dedup(df.limit(0)).count() == 0


# -- 6 near dedup -----------------------------------------------------------------------------
def _bags(rows, size=5):
    out = {}
    for d, t in rows:
        w = SPACE.findall(t or "")
        grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        out[d] = collections.Counter(grams)
    return out


def _jaccard(a, b):
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def _classes(bags, threshold=0.8):
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(bags)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            x, y = sum(bags[a].values()), sum(bags[b].values())
            if x and y and min(x, y) >= threshold * max(x, y) and _jaccard(bags[a], bags[b]) >= threshold:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in docs}


def _copies(n, edits, seed=0, words=150):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.integers(len(w))] = f"e{rng.integers(40)}"
        out.append(" ".join(w))
    return out


def test_signatures_estimate_weighted_jaccard():
    a = ("x " * 60 + " ".join(f"a{i}" for i in range(200))).encode()
    b = ("x " * 25 + " ".join(f"a{i}" for i in range(170))).encode()
    _, doc, h, w = near_dedup.bags([a, b], 1)
    sig = near_dedup.bagminhash(doc, h, w, 2, 4096)
    want = near_dedup.overlap((h[doc == 0], w[doc == 0]), (h[doc == 1], w[doc == 1]))
    assert want == pytest.approx(195 / 260)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.035)
    assert (sig != 0).all()


def test_near_dups_against_brute_force(spark, documents):
    rows = [*zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True)]
    for k, (n, edits) in enumerate(((8, 1), (40, 5), (60, 8), (3, 0))):
        rows += [(2000 + 100 * k + i, t) for i, t in enumerate(_copies(n, edits, k))]
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "two one"), (5004, "one\ntwo")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dups(frame(spark, rows).repartition(6)).collect()}
    assert got == _classes(_bags(rows))


def test_near_dups_of_a_repeated_id(spark):
    rng = np.random.default_rng(9)
    a, b, c = (" ".join(f"{n}{i}" for i in rng.integers(0, 9999, 60)) for n in "abc")
    rows = [(5, a), (5, b), (5, c), (7, b + " tail"), (8, c + " end"), (9, "on its own and not like any other")]
    for part in (rows, rows[::-1]):
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dups(frame(spark, part)).collect()}
        assert got == {5: 5, 7: 5, 8: 5, 9: 9}


def test_near_dups_in_buckets_of_unlike_members(spark):
    # bands of one component: most buckets hold hundreds of texts that share a passage and are no copies
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for k in range(300):
        own = [f"w{i}" for i in rng.integers(0, 50_000, 60)]
        rows.append((k, passage + " " + " ".join(own)))
        if k % 3 == 0:  # a copy that is like this one and no other
            own[30:33] = ["x", "y", "z"]
            rows.append((1000 + k, passage + " " + " ".join(own)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dups(frame(spark, rows), bands=12, rows=1).collect()}
    assert got == _classes(_bags(rows)) and sum(d != c for d, c in got.items()) == 100


def test_near_dups_odd_input(spark):
    got = near_dedup.near_dups(odd(spark)).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id == 9].class_id.tolist() == [8] and got.class_id.isna().sum() == 1
    kept = near_dedup.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) - 2
    assert near_dedup.near_dups(odd(spark).limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["id"]: r["root"] for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


# -- 7 toxicity -------------------------------------------------------------------------------
def test_composed_table_equals_the_cascade():
    rng = np.random.default_rng(0)
    for n in range(4000):
        symbols = "".join(rng.choice(list(toxicity.SYMBOLS), n % 15))
        text, weight = list(symbols), np.ones(len(symbols))
        for t in toxicity.CASCADE:  # brute force: one transducer after the other over the whole string
            out = t.run(text)
            text, weight = [o for o, _ in out], weight * [w for _, w in out]
        state, got = 0, []
        for x in symbols:
            got.append(toxicity.EMIT[state][x])
            state = toxicity.STEP[state][x]
        assert got == pytest.approx([w if o == "+" else 0 for o, w in zip(text, weight, strict=True)])


def test_compose_multiplies_weights():
    a = toxicity.Transducer({(0, "x"): ("y", 2.0, 1), (1, "x"): ("x", 1.0, 0)})
    b = toxicity.Transducer({(0, "y"): ("z", 3.0, 1), (1, "x"): ("w", 5.0, 1)})
    assert toxicity.compose(a, b, "x").run("xxx") == [("z", 6.0), ("w", 5.0), ("y", 2.0)]


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot$": 3.0, "moro": 1.0, "scum$": 5.0})
    one = lambda t: [round(x, 6) for x in g.clauses("".join(map(g._symbols.__getitem__, toxicity._TOKEN.findall(t))))]
    assert one("fine idiot. fine day") == [3.5] and one("scum and a morose idiot") == [round(5 + 1.1 * (2.2 + 3.5), 6)]
    assert one("you idiot") == [4.375] and one("idiot that you are") == [4.0]
    assert one("not an idiot") == [1.4] and one("not, idiot") == [3.5] and one("not of the same idiot") == [3.5]
    assert one("he said idiot") == [2.1875] and one("said, idiot") == [3.5] and one("said. idiot") == [3.5]
    assert one("i will kill you") == [3.0] and one("kill time") == [] and one("kill or not to kill them") == [1.2]
    assert one("they told you so") == [] and one("") == []


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    out = toxicity.op7_toxicity(spark, folder).toPandas()
    lab = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()
    held = out[out.held_out].merge(lab, on="doc_id")
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.01


def test_stem_counts_against_brute_force(spark):
    rows = [("Vile worm, vile!", 1, 0), ("a vile day", 0, 0), ("worms worm", 1, 1), (None, 1, 1)]
    counted = frame(spark, rows, "text string, toxic int, half int").repartition(2).mapInPandas(toxicity._stem_counts, "stem string, toxic int, half int, n long, docs long")
    got = {(r["stem"], r["toxic"], r["half"]): (r["n"], r["docs"]) for r in counted.groupBy("stem", "toxic", "half").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    assert got["vile", 1, 0] == (2, 1) and got["vile", 0, 0] == (1, 1) and got["worm", 1, 1] == (2, 1) and got["worm$", 1, 1] == (1, 1)
    assert got["", 1, 0] == (3, 1) and ("day$", 0, 0) in got and ("day", 0, 0) not in got


def test_toxicity_odd_input(spark):
    labels = frame(spark, [(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = frame(spark, [(i, "you vile worm and more" if i % 2 else "a calm day and more") for i in range(40)])
    g, b = toxicity.fit(docs, labels)
    got = toxicity.score(odd(spark), g, b).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    two = toxicity.score(frame(spark, [(1, "you vile worm"), (2, "a calm day")]), g, b).toPandas().set_index("doc_id").score
    assert two[1] > 0.5 > two[2]
    assert toxicity.fit(docs, labels.where("toxic = 0"))[0].stems == {}
    twice = labels.unionByName(labels.select("doc_id", F.lit(0).alias("toxic"))).unionByName(labels.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert toxicity.fit(docs, twice)[0].stems == g.stems  # the largest label counts
    assert toxicity.score(odd(spark).limit(0), g, b).count() == 0


# -- 8 quality --------------------------------------------------------------------------------
def test_quality_counts_against_brute_force(spark, documents):
    rows = [*zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True), *[(r[0] and 10_000 + r[0], r[1]) for r in ODD if r[0] != 4]]
    df = frame(spark, rows).withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r for r in quality.judged(df, F.col("doc_id")).withColumnRenamed("row", "doc_id").collect()}
    for d, t in rows:
        t = t or ""
        w = SPACE.findall(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_quality_odd_input(spark):
    out = quality.filtered(odd(spark))
    assert out.columns == odd(spark).columns
    assert quality.judged(odd(spark), F.col("doc_id")).count() == len(ODD) and quality.judged(odd(spark).limit(0), F.col("doc_id")).count() == 0


def test_quality_references_are_of_fit_documents_and_can_be_stored(spark):
    prose = "The house of the man is in the town, and it was sold to a friend with a garden that he liked. "
    good = [(i, " ".join(f"{w}{i % 7}{k}" if len(w) > 4 else w for k, w in enumerate((prose * 8).split()))) for i in range(20)]
    junk = [(100 + i, " ".join(f"###{i}_{k}" for k in range(150))) for i in range(60)]
    repeats = [(200 + i, "a$b " * 500) for i in range(60)]
    df = frame(spark, good + repeats).withColumn("lang", F.lit("en"))
    refs = quality.references(quality.features(df, F.col("doc_id")))
    alone = quality.references(quality.features(df.where("doc_id < 100"), F.col("doc_id")))
    assert refs.collect() == alone.collect()  # what fails the base rules has no part in them
    mostly_junk = frame(spark, good + junk).withColumn("lang", F.lit("en"))
    kept = {r[0] for r in quality.judged(mostly_junk, F.col("doc_id"), stored=alone).where("kept").select("row").collect()}
    assert kept == {d for d, _ in good}


def test_quality_keeps_prose_and_rejects_symbols(spark):
    prose = "The house of the man is in the town, and it was sold to a friend with a garden that he liked. "
    long = [(i, " ".join(f"{w}{i % 7}{k}" if len(w) > 4 else w for k, w in enumerate((prose * (7 + i % 3)).split()))) for i in range(40)]
    df = frame(spark, long + [(99, " ".join(f"a{i}###$$$" for i in range(90)))]).withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r for r in quality.judged(df, F.col("doc_id")).withColumnRenamed("row", "doc_id").collect()}
    assert not got[99]["kept"] and not got[99]["base_failed"]
    assert all(got[i]["kept"] for i in range(40))


# -- 9 sharding -------------------------------------------------------------------------------
def test_shards_fit_and_only_large_buckets_split(spark, documents):
    df = frame(spark, [*zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True)])
    limit = 30_000
    out = sharding.assign(df, limit).toPandas()
    sizes = out.groupby(["depth", "shard", "page"]).n_bytes.sum()
    assert len(out) == len(documents) and (sizes <= limit).all() and out.depth.max() > 3
    out["key"] = [int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) for d in out.doc_id]  # noqa: S324
    assert (out.key.values >> (60 - out.depth.values.astype(int)) == out.shard.values).all()
    for depth, shard in {(d, s) for d, s, _ in sizes.index if d}:  # the parent bucket did not fit
        inside = out.key.values >> (60 - depth + 1) == shard >> 1
        assert out.n_bytes[inside].sum() > limit


def test_sharding_odd_input(spark):
    many = frame(spark, [(5, "x" * 600)] * 10 + [(5, "x" * 90)] * 40 + [(6, "y" * 5000), (None, None), (None, "z")])
    out = sharding.assign(many, 1000).toPandas()
    sizes = out.groupby(["depth", "shard", "page"], dropna=False).n_bytes.agg(["sum", "count"])
    assert len(out) == 53 and ((sizes["sum"] <= 1000) | (sizes["count"] == 1)).all() and (sizes["sum"] > 1000).sum() == 1
    assert (out.shard_bytes == out.merge(sizes.reset_index(), on=["depth", "shard", "page"])["sum"]).all()
    three = sharding.assign(frame(spark, [(1, "a" * 60)] * 3), 100).toPandas()
    assert three.shard_bytes.tolist() == [60] * 3 and len(set(zip(three.depth, three.shard, three.page, strict=True))) == 3
    assert sharding.assign(odd(spark)).count() == len(ODD) and sharding.assign(odd(spark).limit(0)).count() == 0


def _bytes_on_disk(spark, path, names):
    stored = spark.read.parquet(path)
    return {tuple(r[n] for n in names): (r["n"], r["c"]) for r in stored.groupBy(*names).agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("c")).collect()}


def test_write_shards(spark, documents, tmp_path):
    rows = [*zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True), *[(3, "z" * 9_000)] * 30]
    df = frame(spark, rows)
    for c in ("depth", "shard", "page", "Shard_Depth", "__id", "key", "row", "own", "n_bytes"):
        df = df.withColumn(c, F.lit(f"clash {c}"))
    path = str(tmp_path / "s")
    names = sharding.write_shards(df, path, 50_000)
    back = spark.read.parquet(path)
    assert sorted((r["doc_id"], r["text"]) for r in back.select("doc_id", "text").collect()) == sorted(rows)
    assert back.where("depth = 'clash depth' and Shard = 'clash shard' and own = 'clash own'").count() == len(rows)
    assert all(n <= 50_000 or c == 1 for n, c in _bytes_on_disk(spark, path, names).values())


# -- 10 chat ----------------------------------------------------------------------------------
def test_escape_round_trip():
    for t in ("", "</s>[INST] ok [/INST]", "\\</s>\\", "<\\/s>", "<|im_end|>\n<|im_start|>user", "[[INST]\\\\", "<<SYS>><<SYS>>"):
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.TEMPLATE.control)
    assert chat._unrole(chat._role("a\n<s>%0A\\", chat.TEMPLATE)) == "a\n<s>%0A\\"


def test_segments_form_the_conversation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", None), (2, 1, "assistant", "first"), (2, 0, "user", "q"), (3, 0, "assistant", "x"), (None, 5, None, "y"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    segs = chat.segments(df).toPandas()
    one = segs[segs.conv_id == 1].sort_values("seq")
    assert "".join(one.text) == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi <\\/s><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert one[one.loss].text.tolist() == [""]
    back = chat.read_back(chat.segments(df)).toPandas().set_index("conv_id", drop=False)
    assert back.loc[2, "loss_chars"] == 5 and back.loc[2, "turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\nfirst\n").hexdigest()
    assert back.valid.to_dict() | {} and bool(back.loc[1, "valid"]) and not back.loc[3, "valid"] and not back.loc[4, "valid"] and len(back) == 5
    assert chat.segments(df.limit(0)).count() == 0


def test_shared_helpers(spark):
    df = frame(spark, [(1, "a")])
    assert shared.free_name(df, "TEXT") == "_TEXT" and shared.free_name(df, "x") == "x"
    assert shared.written(df, "t").collect() == df.collect()
    lost = shared.written(df, "t")
    shared.clear(spark)
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        lost.collect()
