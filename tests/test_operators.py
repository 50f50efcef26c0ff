"""Operators by hand numbers, invariants, planted signals and degenerate input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentra.functions import answers, parsing, text
from momentra.operators import evaluate, fusion, greedy, objects, rerank, rows, sequence
from momentra.sources import files, providers
from momentra.streaming import breaker

from .conftest import frame

SCORES = "query_id long, signal string, global_id long, score double"


def as_map(df):
    return {(r["query_id"], r["global_id"]): round(r["score"], 9) for r in df.collect()}


def test_weighted_sum_flat_map_scores_one_and_zero_weight_adds_no_ids(spark):
    s = frame(spark, [(0, "a", 1, 5.0), (0, "a", 2, 5.0), (0, "b", 2, 1.0), (0, "b", 3, 3.0), (0, "c", 9, 1.0)], SCORES)
    assert as_map(fusion.weighted_sum(s, {"a": 1.0, "b": 0.5, "c": 0.0})) == {(0, 1): 1.0, (0, 2): 1.0, (0, 3): 0.5}


def test_rrf_and_means(spark):
    s = frame(spark, [(0, "a", 1, 5.0), (0, "a", 2, 4.0), (0, "b", 2, 1.0)], SCORES)
    assert as_map(fusion.rrf(s)) == {(0, 1): round(1 / 61, 9), (0, 2): round(1 / 62 + 1 / 61, 9)}
    assert as_map(fusion.aggregate_variants(s, mean=True))[0, 2] == 2.5
    assert as_map(fusion.aggregate_variants(s.limit(0))) == {}


def test_neighbor_boost_stays_inside_video_and_reads_given_scores(spark):
    s = frame(spark, [(0, 1, "x", 1.0), (0, 2, "x", 2.0), (0, 3, "y", 4.0)], "query_id long, global_id long, video_id string, score double")
    assert as_map(fusion.neighbor_boost(s)) == {(0, 1): 1.2, (0, 2): 2.1, (0, 3): 4.0}


@pytest.mark.parametrize("seed", range(3))
def test_consistency_boost_against_loops(spark, seed):
    rng = random.Random(seed)
    scores = {g: rng.uniform(-1, 3) for g in rng.sample(range(30), 14)}
    top = max(scores.values())
    want = {}
    for g, s in scores.items():
        support = 0.0
        for d in (1, 2):
            left, right = (scores.get(g + o, 0.0) if (g + o) // 10 == g // 10 else 0.0 for o in (-d, d))
            if left > 0 or right > 0:
                support += 0.5**d * ((left + right) / 2) / top
        want[0, g] = round(s + (0.15 * top * support / 0.75 if support > 0 and top > 0 else 0.0), 9)
    df = frame(spark, [(0, g, f"v{g // 10}", s) for g, s in scores.items()], "query_id long, global_id long, video_id string, score double")
    assert as_map(fusion.consistency_boost(df)) == want


def _chain_rows(video, sims):
    return [(0, video, n, float(t), e, s) for n, t, e, s in sims]


SIMS = "query_id long, video_id string, n int, time double, event_idx int, sim double"


def test_alignment_planted_chain_beats_decoy_and_latest_tie_wins(spark):
    good = [(1, 0, 0, 0.9), (5, 40, 1, 0.9), (9, 80, 2, 0.9)]
    decoy = [(20, 1000, 0, 1.0), (21, 1400, 1, 1.0), (22, 1800, 2, 1.0)]
    tie = [(1, 0, 0, 0.5), (2, 10, 0, 0.5), (3, 20, 1, 0.5)]
    df = frame(spark, _chain_rows("a", good + decoy) + _chain_rows("b", tie), SIMS)
    out = {(r["video_id"], r["last"]): r for r in sequence.align(df, 3, 150.0).collect()}
    assert [*out] == [("a", 9)] and out["a", 9]["frames"] == [1, 5, 9]
    assert out["a", 9]["score"] == pytest.approx((2.7 - 0.0005 * 80) / 3)
    two = sequence.align(df.where("video_id = 'b'"), 2, 150.0, penalty=0.0).collect()
    assert two[0]["frames"] == [2, 3]


def test_alignment_forms_agree(spark):
    rng = random.Random(4)
    df = frame(spark, [(0, f"v{v}", n, n * 5.0, e, rng.random()) for v in range(3) for n in range(25) for e in range(3)], SIMS)
    a = {(r["video_id"], r["last"]): round(r["score"], 9) for r in sequence.align(df, 3, 40.0, floor=0.3).collect()}
    b = {(r["video_id"], r["last"]): round(r["score"], 9) for r in sequence.align_grouped(df, 3, 40.0, floor=0.3).collect()}
    assert a == b and a
    best = {r["video_id"]: r["score"] for r in sequence.beam(df, 3, width=200, max_gap=40.0, floor=0.3).groupBy("video_id").agg(F.max("score").alias("score")).collect()}
    free = {r["video_id"]: r["s"] for r in sequence.align(df, 3, 40.0, floor=0.3, penalty=0.0).groupBy("video_id").agg(F.max("score").alias("s")).collect()}
    assert {k: round(v, 9) for k, v in best.items()} == {k: round(v, 9) for k, v in free.items()}


def test_match_monotonic_against_enumeration(spark):
    import itertools

    rng = random.Random(2)
    cost = {(k, p): rng.randint(0, 64) for k in range(4) for p in range(7)}
    df = frame(spark, [("v", k, p, c) for (k, p), c in cost.items()], "video_id string, hash_no int, position int, cost int")
    got = sequence.match_monotonic(df, 4).first()
    assert got["total"] == min(sum(cost[k, p] for k, p in enumerate(c)) for c in itertools.combinations_with_replacement(range(7), 4))
    assert got["positions"] == sorted(got["positions"])


def test_monotonize(spark):
    df = frame(spark, [([5, 5, 6],), ([3, 2],), ([1],), ([1, 1, 1],)], "f array<long>")
    assert [r[0] for r in df.select(sequence.monotonize(F.col("f"))).collect()] == [[5, 6, 7], None, [1], [1, 2, 3]]


RUN = "query_id long, rank int, video_id string, frame_idx long, answer string, score double"


def run_rows(n=60, seed=0, videos=6):
    rng = random.Random(seed)
    seen = rng.sample([(v, f) for v in range(videos) for f in range(40)], n)
    return [(0, i + 1, f"L01_V{v + 1:03d}", f * 25, f"answer {f % 3}", 1.0 / (i + 1)) for i, (v, f) in enumerate(seen)]


def test_head_diversify_is_a_permutation_with_caps(spark):
    data = run_rows()
    data = sorted(data, key=lambda r: r[2])
    df = frame(spark, [(0, i + 1, *r[2:]) for i, r in enumerate(data)], RUN)
    out = sorted(rows.head_diversify(df).collect(), key=lambda r: r["rank"])
    assert sorted((r["video_id"], r["frame_idx"]) for r in out) == sorted((r[2], r[3]) for r in data)
    assert max(sum(r["video_id"] == v for r in out[:5]) for v in {r[2] for r in data}) <= 2
    assert out[0]["video_id"] == data[0][2]


def test_tail_shapers_keep_the_head_and_the_limit(spark):
    df = frame(spark, run_rows(100), RUN)
    grid = frame(spark, [(f"L01_V{v + 1:03d}", f * 25) for v in range(6) for f in range(40)], "video_id string, frame_idx long")
    out = sorted(rows.diversify_tail(df, rows.variant_frames(grid)).collect(), key=lambda r: r["rank"])
    head = sorted(df.collect(), key=lambda r: r["rank"])[:30]
    assert [(r["video_id"], r["frame_idx"]) for r in out[:30]] == [(r["video_id"], r["frame_idx"]) for r in head]
    assert len(out) == 100 and len({(r["video_id"], r["frame_idx"]) for r in out}) == 100
    short = df.where("rank <= 20")
    assert rows.diversify_tail(short, rows.variant_frames(grid)).count() == 20


def test_merge_of_one_run_keeps_its_order(spark):
    df = frame(spark, run_rows(), RUN).withColumn("run", F.lit("a"))
    out = sorted(rows.merge_runs(df, {"a": 1.0}).collect(), key=lambda r: r["rank"])
    assert [(r["video_id"], r["frame_idx"]) for r in out] == [(r[2], r[3]) for r in run_rows()]


def test_writer_rows_reject_bad_and_repeated(spark):
    bad = [(0, 1, "bad", 1, "a", 0.0), (0, 2, "L01_V001", -1, "a", 0.0), (0, 3, "L01_V001", 5, "A", 0.0), (0, 4, "L01_V001", 5, "a", 0.0)]
    df = frame(spark, bad, RUN)
    assert [(r["rank"], r["frame_idx"]) for r in rows.kis_rows(df).collect()] == [(1, 5)]
    assert rows.qa_rows(df).count() == 1
    t = frame(spark, [(0, 1, "L01_V001", [1, 2]), (0, 2, "L01_V001", [2, 2]), (0, 3, "L01_V001", []), (0, 4, "L01_V001", [1, 2])], "query_id long, rank int, video_id string, frames array<long>")
    assert rows.trake_rows(t).count() == 1


GT = "query_id long, event_idx int, video_id string, lo long, hi long, answers array<string>"


def test_worked_examples_of_the_score(spark):
    gt = frame(spark, [(0, j, "v", 100 * j, 100 * j + 10, []) for j in range(4)], GT)
    t = frame(spark, [(0, 1, "v", [5, 105, 205, 999])], "query_id long, rank int, video_id string, frames array<long>")
    assert evaluate.trake_scores(t, gt).first()["r"] == 0.75
    scored = frame(spark, [(0, 1, 0.5), (0, 3, 0.7), (0, 15, 0.8), (0, 40, 0.8), (0, 90, 0.9), (0, 101, 1.0)], "query_id long, rank int, r double")
    assert evaluate.r_at_k(scored).first()["final"] == pytest.approx(0.74)
    ranks = frame(spark, [(1,), (5,), (20,), (50,), (100,), (101,), (None,)], "f int")
    assert [r[0] for r in ranks.select(evaluate.qualifier(F.col("f"))).collect()] == [1.0, 0.8, 0.6, 0.4, 0.2, 0.0, 0.0]


def test_report_counts_missing_as_zero_and_null_events_as_misses(spark):
    entries = frame(spark, [(0, "kis"), (1, "kis"), (2, "qa")], "query_id long, task string")
    scores = frame(spark, [(0, 1.0), (2, 0.5)], "query_id long, final double")
    out = {r["task"]: (r["n"], r["scored"], r["mean_final"]) for r in evaluate.report(scores, entries).collect()}
    assert out == {"kis": (2, 1, 0.5), "qa": (1, 1, 0.5), "all": (3, 2, 0.5)}
    gt = frame(spark, [(0, 0, "v", 0, 9, []), (0, 1, "v", None, None, [])], GT)
    t = frame(spark, [(0, 1, "v", [5, 50])], "query_id long, rank int, video_id string, frames array<long>")
    assert evaluate.trake_scores(t, gt).first()["r"] == 0.5


def test_ground_truth_spellings(spark):
    cases = {
        0: '{"video_id": "v", "range": [1, 2]}', 1: '{"video_id": "v", "center": 5, "epsilon": 2, "answer": "x"}', 2: '{"video_id": "v", "centers": [5, 9], "epsilon": 1}',
        3: '{"video_id": "v", "ranges": [[1, 2], [8, 9]]}', 4: '{"task": "TRAKE", "video_id": "v", "events": [[1, 2], [9, 3]]}', 5: '{"video_id": "v", "moments": [[4, 4]], "answers": ["a", "b"]}',
    }
    df = frame(spark, list(cases.items()), "query_id long, json string")
    got = {}
    for r in sorted(files.parse_ground_truth(df).collect(), key=lambda r: (r["query_id"], r["event_idx"])):
        got.setdefault(r["query_id"], []).append((r["task"], r["lo"], r["hi"]))
    assert got == {0: [("kis", 1, 2)], 1: [("qa", 3, 7)], 2: [("trake", 4, 6), ("trake", 8, 10)], 3: [("kis", 1, 2), ("kis", 8, 9)], 4: [("trake", 1, 2), ("trake", None, None)], 5: [("qa", 4, 4)]}
    with pytest.raises(ValueError, match="ground truth"):
        files.check_ground_truth(files.parse_ground_truth(frame(spark, [(0, "{}")], "query_id long, json string")))


def test_text_functions(spark):
    df = frame(spark, [("Hà Nội, ĐƯỜNG phố! Straßé",)], "t string")
    assert df.select(text.tokenize(F.col("t"))).first()[0] == ["ha", "noi", "duong", "pho", "straße"]
    assert df.select(text.normalize_answer(F.lit("  STRAßE  a. ?!"))).first()[0] == "strasse a"
    cues = frame(spark, [("the SIGN says hello",), ("designs",)], "t string")
    assert [r[0] for r in cues.select(text.cue_scale(F.col("t"), text.OCR_CUES)).collect()] == [2.0, 1.0]
    assert df.select(text.strip_invisible(F.lit("a​b"))).first()[0] == "ab"


def test_answer_forms(spark):
    cases = {"7 cái.": "7 cái", "hai mươi bảy": "27", "300kg": "300 kg", "-5": "-5", "1.000": "1000", "3,5": "3.5", "**Đáp án: 5**": "5", "06": "6", "một trăm linh năm mét": "105 m", "mười lăm": "15", "tư vấn": "tư vấn", "88 phần trăm": "88%"}
    df = frame(spark, [(k,) for k in cases], "a string")
    assert [r[0] for r in df.select(answers.canonical_key(F.col("a"), 2)).collect()] == [*cases.values()]
    assert df.where("a = '-5'").select(answers.canonical_key(F.col("a"), 3)).first()[0] == "-5"
    assert answers.variants("7 cái.") == ["bảy cái.", "7"] and answers.variants("sáu") == ["6"] and answers.variants("không rõ") == []
    assert [answers.fold_numbers(answers._say(n)) for n in range(1, 1000)] == [str(n) for n in range(1, 1000)]


def test_parsing(spark):
    q = frame(spark, [(0, "a man opens a red door after the dog has left the house"), (1, "after that"), (2, "no marker here at all")], "query_id long, text string")
    assert [r["direction"] for r in parsing.split_temporal(q).orderBy("query_id").collect()] == ["before", None, None]
    lines = frame(spark, [(0, 0, "Header"), (0, 1, "E1 one"), (0, 2, "E2: two"), (0, 3, "E3")], "k long, line_no int, line string")
    assert [(r["event_idx"], r["event"]) for r in parsing.trake_events(lines, ["k"]).orderBy("event_idx").collect()] == [(0, "one"), (1, "two")]
    s = frame(spark, [("```json\n[1, 20, -3]\n```",), ("[1]",)], "s string")
    assert [r[0] for r in s.select(parsing.llm_scores(F.col("s"), 3)).collect()] == [[1.0, 10.0, 0.0], None]


def test_objects(spark):
    d = frame(spark, [(1, "car", 0.9, 0.2), (1, "car", 0.9, 0.8), (1, "dog", 0.2, 0.1), (2, "car", 0.5, 0.9)], "frame long, entity string, score double, x double")
    got = {r["frame"]: r["score"] for r in objects.score(d, [("car", 3, None), ("dog", None, None), ("car", None, "left")]).collect()}
    assert got == pytest.approx({1: (0.5 + 0 + 1) / 3, 2: (0.2 + 0 + 0) / 3})
    parsed = objects.parse(frame(spark, [(0, "two red cars on the left near a dog")], "query_id long, text string"), ["car", "red cars", "dog"]).collect()
    assert [(r["entity"], r["want"]) for r in parsed] == [("red cars", 2), ("dog", 1)]


def test_greedy(spark):
    v = [(i, "a", i, [float(np.cos(x)), float(np.sin(x))]) for i, x in enumerate((0.0, 0.1, 0.2, 0.3, 1.5))]
    kept = greedy.suppress_near_dups(frame(spark, v, "global_id long, video_id string, n int, v array<double>"), 0.97)
    assert {r["global_id"] for r in kept.where("kept").collect()} == {0, 3, 4}  # against the last kept, not the one before
    data = [(0, i + 1, f"v{i % 2}", i, float(i)) for i in range(20)]
    out = greedy.diversify(frame(spark, data, "query_id long, rank int, video_id string, global_id long, pts_time double"), 2, 10.0, 20)
    assert [r["global_id"] for r in out.orderBy("pos").collect()][:4] == [0, 1, 10, 11]


def test_zero_vector_scores_zero(spark):
    pool = frame(spark, [(0, 1, [1.0, 0.0]), (0, 2, [0.0, 0.0]), (0, 3, [0.6, 0.8])], "query_id long, global_id long, v array<double>")
    q = frame(spark, [(0, [1.0, 0.0])], "query_id long, qv array<double>")
    out = {r["global_id"]: r["score"] for r in rerank.superglobal(pool, q, 2).collect()}
    assert out[2] == 0.0 and out[1] > out[3] > 0


def test_breaker_stream_equals_state_machine(spark, tmp_path):
    rng = random.Random(1)
    data = [(m, n, 10.0 * n, rng.random() < 0.6) for m in range(3) for n in range(40)]
    schema = "model long, n long, at double, failed boolean"
    frame(spark, data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = breaker.breaker_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("actions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = []
    for m in range(3):
        state = ("", 0, 0.0)
        for model, n, at, failed in data:
            if model == m:
                state, did = breaker.step(state, at, failed)
                want.append((m, n, did))
    assert sorted(tuple(r) for r in spark.sql("select model, n, action from actions").collect()) == sorted(want)
    assert {"opened", "skipped", "closed"} <= {w[2] for w in want}


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "run"
    folder.mkdir()
    (folder / "q1.csv").write_text('L01_V001,5,"a ""b"", c"\n\nL01_V002,6,x\n', encoding="utf-8")
    got = sorted((r["stem"], r["rank"], r["video_id"], r["frame_idx"], r["answer"]) for r in files.read_run(spark, str(folder)).collect())
    assert got == [("q1", 1, "L01_V001", 5, 'a "b", c'), ("q1", 2, "L01_V002", 6, "x")]
    maps = tmp_path / "maps"
    maps.mkdir()
    (maps / "L01_V001.csv").write_text("﻿n,pts_time,fps,frame_idx\n1,0.0,25,0\nbad\n2,4.0,25,100.0\n", encoding="utf-8")
    assert sorted((r["video_id"], r["n"], r["frame_idx"]) for r in files.read_map_csv(spark, str(maps)).collect()) == [("L01_V001", 1, 0), ("L01_V001", 2, 100)]
    with pytest.raises(ValueError, match="negative"):
        files.write_map_csv(frame(spark, [(1, 0.0, 25.0, -1)], "n int, pts_time double, fps double, frame_idx long"), str(tmp_path / "out"))
    rows_in = frame(spark, [(0, 1, "L01_V001", [1, 2], "x, y")], "query_id long, rank int, video_id string, frames array<long>, answer string")
    files.write_submission(rows_in, str(tmp_path / "sub"))
    assert files.package(spark, files.submission_lines(rows_in), str(tmp_path / "m")).first()["rows"] == 1


class _Lengths:
    def encode_text(self, texts):
        return [[float(len(t))] for t in texts]

    def score(self, query, items):
        return [float(len(query) - len(i)) for i in items]


def test_provider_seams(spark):
    df = frame(spark, [("a", "bb"), ("ccc", None)], "q string, text string")
    assert sorted(r["v"] for r in providers.encode(df, _Lengths).collect()) == [[0.0], [2.0]]
    out = providers.rerank_scores(df.fillna("", ["text"]), _Lengths, "q", "text")
    assert sorted(r["cross"] for r in out.collect()) == [-1.0, 3.0]
    img = frame(spark, [(list(range(72)),)], "gray array<int>")
    assert providers.difference_hash(img).first()["dhash"] == -1
    providers.register("x", _Lengths)
    assert "x" in providers.known()


def test_engine_api(spark):
    from momentra.api import Engine

    e = Engine(spark, "/root/testdata/sf0.001")
    assert e.health() == {"frames": 500, "videos": 25}
    q = e.tables.queries(e.tables.vectors, 3)
    first = {r["query_id"]: r["global_id"] for r in e.search(q).where("rank = 1").collect()}
    assert set(first) == {0, 1, 2}
    assert e.nearest(5, 4).where("global_id = 5").count() == 0 and e.nearest(5, 4).count() == 4
    assert 0 < e.avs(q, 50).count() <= 150
    events = e.tables.queries(e.tables.vectors, 2).select(F.lit(0).cast("long").alias("query_id"), F.col("query_id").cast("int").alias("event_idx"), "qv")
    chains = e.trake(events, 2).collect()
    assert all(r["frames"][0] < r["frames"][1] for r in chains) and chains


def test_rebuild_map_finds_planted_frames(spark):
    from momentra.operators import alignment

    rng = random.Random(5)
    stream = [("v", f, rng.getrandbits(62)) for f in range(40)]
    keys = [("v", k, stream[f][2] ^ 1) for k, f in enumerate((4, 12, 13, 36))]
    got = alignment.rebuild_map(frame(spark, keys, "video_id string, hash_no int, h long"), frame(spark, stream, "video_id string, frame_idx int, h long"), 4, around=3)
    frames = [r["frame_idx"] for r in got.orderBy("hash_no").collect()]
    assert frames[0] == 4 and frames[3] == 36 and frames == sorted(set(frames))


def test_batch_plan_skips_finished(spark):
    from momentra.operators import batch

    pack = frame(spark, [("b-qa",), ("a-trake",), ("c",), ("d",)], "name string")
    done = frame(spark, [("c", 5, 0), ("d", 5, 1)], "name string, n_rows int, n_issues int")
    got = [(r["name"], r["sprint"]) for r in batch.plan(pack, done, F.lit(40)).orderBy("pos").collect()]
    assert got == [("d", False), ("a-trake", True), ("b-qa", True)]
