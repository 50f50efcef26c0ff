"""Scalar functions as queries (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, parsing, text
from ..functions.vectors import l2_normalize, norm, truncate
from .base import query

_LOW = r"trim(regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_\p{{M}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _docs(t):
    return t.raw("documents").select("doc_id", "text")


@query("normalize_text", f"SELECT doc_id, md5({_LOW.format(t='text')}) AS digest FROM documents")
def normalize_text(t):
    return _docs(t).select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@query("fold_diacritics", "SELECT doc_id, md5(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))) AS digest FROM documents")
def fold_diacritics(t):
    return _docs(t).select("doc_id", F.md5(text.fold_diacritics(F.col("text"))).alias("digest"))


@query("tokenize", "SELECT key, count(*) AS distinct_tokens, CAST(sum(tf) AS BIGINT) AS tokens FROM post GROUP BY key")
def tokenize(t):
    tokens = text.tokenize(F.col("text"))
    return _docs(t).select(F.col("doc_id").alias("key"), F.size(F.array_distinct(tokens)).alias("distinct_tokens"), F.size(tokens).cast("long").alias("tokens")).where("tokens > 0")


_ANSWER = r"regexp_replace(trim(regexp_replace(replace(lower({a}), 'ß', 'ss'), '\s+', ' ', 'g')), '[.,;:!?…\"''”’)\]\s]+$', '')"


@query("normalize_answer", f"SELECT doc_id, {_ANSWER.format(a='text')} AS answer FROM documents")
def normalize_answer(t):
    return _docs(t).select("doc_id", text.normalize_answer(F.col("text")).alias("answer"))


#: Answers in many forms, made from ids: the functions below need text that no table holds.
_FORMS = ("7 cái.", "hai mươi bảy", "300kg", "-5", "1.000", "3,5", "**Đáp án: 5**", "một trăm linh năm mét", '"Đáp án: X"', "không rõ", "sáu người", "06", "88 phần trăm", "mười lăm", "tư vấn")


def _forms(t):
    forms = F.array(*map(F.lit, _FORMS))
    return t.raw("benchmark").select("item_id", F.get(forms, (F.col("item_id") % len(_FORMS)).cast("int")).alias("answer"))


@query("strip_decoration")
def strip_decoration(t):
    return _forms(t).select("item_id", answers.strip_decoration(F.col("answer")).alias("answer"))


@query("canonical_key")
def canonical_key(t):
    return _forms(t).select("item_id", *[answers.canonical_key(F.col("answer"), k).alias(f"tier_{k}") for k in range(4)])


@query("fold_numbers_vi")
def fold_numbers_vi(t):
    return _forms(t).select("item_id", answers.fold_numbers_column(F.lower("answer")).alias("answer"))


@query("fold_units")
def fold_units(t):
    return _forms(t).select("item_id", answers.fold_units_column(F.lower("answer")).alias("answer"))


_D = "['không', 'một', 'hai', 'ba', 'bốn', 'năm', 'sáu', 'bảy', 'tám', 'chín']"


@query("num_to_words_vi", f"""
WITH d AS (SELECT n, {_D} AS w, n % 10 AS u, n // 10 % 10 AS z, n // 100 AS h FROM range(0, 1000) AS r(n)),
two AS (SELECT *, CASE WHEN z = 1 THEN 'mười' || CASE WHEN u = 0 THEN '' WHEN u = 5 THEN ' lăm' ELSE ' ' || w[u + 1] END ELSE w[z + 1] || ' mươi' || CASE u WHEN 0 THEN '' WHEN 1 THEN ' mốt' WHEN 4 THEN ' tư' WHEN 5 THEN ' lăm' ELSE ' ' || w[u + 1] END END AS t FROM d)
SELECT n, CASE WHEN n < 10 THEN w[u + 1] WHEN n < 100 THEN t WHEN n % 100 = 0 THEN w[h + 1] || ' trăm' WHEN z = 0 THEN w[h + 1] || ' trăm linh ' || w[u + 1] ELSE w[h + 1] || ' trăm ' || t END AS words FROM two""")
def num_to_words_vi(t):
    return t.spark.range(1000).select(F.col("id").alias("n"), answers.num_to_words(F.col("id")).alias("words"))


@query("answer_variants")
def answer_variants(t):
    return _forms(t).select("item_id", answers.answer_variants(F.col("answer")).alias("variants"))


@query("sanitize_answer", r"""
WITH s AS (SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 100) AS a FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(a, '[",]') THEN '"' || replace(a, '"', '""') || '"' ELSE a END AS answer FROM s""")
def sanitize_answer(t):
    return _docs(t).select("doc_id", text.sanitize_answer(F.col("text")).alias("answer"))


@query("infer_task", "SELECT page_id, CASE WHEN contains(lower(n), 'trake') THEN 'trake' WHEN contains(lower(n), 'avs') THEN 'avs' WHEN contains(lower(n), 'qa') THEN 'qa' ELSE 'kis' END AS task FROM (SELECT page_id, 'query-' || page_id || ['-TRAKE', '-qa', '-AVS-qa', '', '-kis'][page_id % 5 + 1] AS n FROM pages)")
def infer_task(t):
    kinds = F.array(*map(F.lit, ("-TRAKE", "-qa", "-AVS-qa", "", "-kis")))
    name = F.concat(F.lit("query-"), F.col("page_id"), F.get(kinds, (F.col("page_id") % 5).cast("int")))
    return t.raw("pages").select("page_id", text.infer_task(name).alias("task"))


def _cue_sql(cues: tuple) -> str:
    return rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(cues)})($|[^\p{{L}}\p{{N}}_])')"


@query("query_signal_cues", f"SELECT doc_id, CASE WHEN {_cue_sql(text.OCR_CUES)} THEN 2.0 ELSE 1.0 END AS ocr, CASE WHEN {_cue_sql(text.ASR_CUES)} THEN 2.0 ELSE 1.0 END AS asr FROM documents")
def query_signal_cues(t):
    return _docs(t).select("doc_id", text.cue_scale(F.col("text"), text.OCR_CUES).alias("ocr"), text.cue_scale(F.col("text"), text.ASR_CUES).alias("asr"))


@query("split_temporal_query", r"""
WITH q AS (SELECT item_id, left(text, 30) || [' sau khi ', ' before ', ' AFTER ', ' and '][item_id % 4 + 1] || right(text, 10 + item_id % 5) AS t FROM benchmark),
m AS (SELECT item_id, t, CASE item_id % 4 WHEN 0 THEN instr(lower(t), ' sau khi ') WHEN 1 THEN instr(lower(t), ' before ') WHEN 2 THEN instr(lower(t), ' after ') END AS p, CASE item_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 8 ELSE 7 END AS k FROM q)
SELECT item_id, CASE WHEN p IS NULL THEN '' WHEN length(trim(left(t, p))) < 12 OR length(trim(substr(t, p + k))) < 12 THEN '' WHEN item_id % 4 = 1 THEN 'after' ELSE 'before' END AS direction FROM m""")
def split_temporal_query(t):
    marks = F.array(*map(F.lit, (" sau khi ", " before ", " AFTER ", " and ")))
    q = F.concat(F.left("text", F.lit(30)), F.get(marks, (F.col("item_id") % 4).cast("int")), F.right("text", (F.col("item_id") % 5 + 10).cast("int")))
    return parsing.split_temporal(t.raw("benchmark").select("item_id", q.alias("text"))).select("item_id", F.coalesce("direction", F.lit("")).alias("direction"))


@query("parse_objects")
def parse_objects(t):
    from ..operators import objects

    said = F.concat(F.lit("two red cars on the left, 3 people and a traffic light near car number "), F.col("item_id"))
    return objects.parse(t.raw("benchmark").select(F.col("item_id").alias("query_id"), said.alias("text")), ["car", "cars", "red cars", "people", "traffic light", "light"])


@query("parse_trake_events", """
WITH e AS (SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'Header' ELSE 'E' || turn || ': scene ' || turn END AS line FROM conversations),
k AS (SELECT *, regexp_matches(line, '^\\s*[Ee][0-9]{1,2}\\s*([:.)-]|\\s)') AS marked, count(*) FILTER (regexp_matches(line, '^\\s*[Ee][0-9]{1,2}\\s*([:.)-]|\\s)')) OVER (PARTITION BY conv_id) AS n FROM e)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS event_idx, CASE WHEN marked THEN regexp_replace(line, '^\\s*[Ee][0-9]{1,2}\\s*([:.)-]\\s*|\\s+)', '') ELSE line END AS event FROM k WHERE marked OR n < 2""".replace("\\\\", "\\"))
def parse_trake_events(t):
    c = t.raw("conversations")
    line = F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), "Header").otherwise(F.concat(F.lit("E"), "turn", F.lit(": scene "), "turn"))
    return parsing.trake_events(c.select(F.col("conv_id"), F.col("turn").alias("line_no"), line.alias("line")), ["conv_id"])


@query("split_qa_line", r"""
WITH q AS (SELECT item_id, 'Mô tả ' || item_id || CASE item_id % 3 WHEN 0 THEN '. Hỏi xe màu gì?' WHEN 1 THEN '. Đây là cảnh gì?' ELSE '. Không có.' END AS t FROM benchmark)
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Mô tả ' || item_id || '.' WHEN 1 THEN 'Mô tả ' || item_id || '.' ELSE t END AS context, CASE item_id % 3 WHEN 0 THEN 'xe màu gì?' WHEN 1 THEN 'Đây là cảnh gì?' ELSE '' END AS question FROM q""")
def split_qa_line(t):
    tail = F.when(F.col("item_id") % 3 == 0, ". Hỏi xe màu gì?").when(F.col("item_id") % 3 == 1, ". Đây là cảnh gì?").otherwise(". Không có.")
    return parsing.split_qa(t.raw("benchmark").select("item_id", F.concat(F.lit("Mô tả "), "item_id", tail).alias("text"))).select("item_id", "context", "question")


@query("kis_events", r"""
WITH s AS (SELECT item_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(list_filter(regexp_split_to_array(trim(x), '\s+'), lambda w: w <> '')) >= 6) AS e FROM benchmark)
SELECT item_id, CASE WHEN len(e) >= 3 THEN least(len(e), 6) ELSE 0 END AS n_events FROM s""")
def kis_events(t):
    return parsing.kis_events(t.raw("benchmark").select("item_id", "text")).select("item_id", F.size("events").alias("n_events"))


@query("media_text_blob", "SELECT page_id, trim(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) || ' ' || url || ' red car') AS blob FROM pages")
def media_text_blob(t):
    from ..sources.files import parse_media_info

    p = t.raw("pages").withColumn("title", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    k = F.when(F.col("page_id") % 2 == 0, "['red', 'car']").otherwise("red, car")
    json = F.to_json(F.struct("title", F.col("url").alias("description"), k.alias("keywords")))
    return parse_media_info(p.select("page_id", json.alias("json"))).select("page_id", "blob")


@query("watch_url", "SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&t=' ELSE '?t=' END || CAST(floor(page_id * 1.5) AS BIGINT) || 's' AS watch FROM pages")
def watch_url(t):
    return t.raw("pages").select("page_id", text.watch_url(F.col("url"), F.col("page_id") * 1.5).alias("watch"))


@query("deadline_minutes", """
WITH m AS (SELECT event_id, (CAST(extract(hour FROM ts) AS BIGINT) * 60 + CAST(extract(minute FROM ts) AS BIGINT) + 420) % 1440 AS now, event_id % 24 * 60 + event_id % 60 AS close FROM events),
w AS (SELECT event_id, CASE WHEN close - now < -720 THEN close - now + 1440 WHEN close - now > 720 THEN close - now - 1440 ELSE close - now END AS left_min FROM m)
SELECT event_id, left_min, round(greatest(5, (left_min - 25) * 0.45), 6) AS budget FROM w""")
def deadline_minutes(t):
    hhmm = F.format_string("%02d:%02d", (F.col("event_id") % 24).cast("int"), (F.col("event_id") % 60).cast("int"))
    left = parsing.minutes_until(hhmm, F.col("ts"), 420)
    return t.raw("events").select("event_id", left.alias("left_min"), F.round(parsing.governed(left), 6).alias("budget"))


@query("frame_ms", "SELECT global_id, CAST(round(frame_idx / fps * 1000) AS BIGINT) AS ms, round(frame_idx / fps, 6) AS pts FROM catalog")
def frame_ms(t):
    return t.catalog.select("global_id", F.round(F.col("frame_idx") / F.col("fps") * 1000).cast("long").alias("ms"), F.round(F.col("frame_idx") / F.col("fps"), 6).alias("pts"))


@query("range_from_center", "SELECT global_id, frame_idx - 12 AS lo, frame_idx + 12 AS hi FROM catalog")
def range_from_center(t):
    windows = F.transform(F.array("frame_idx"), lambda c: F.struct((c - 12).alias("lo"), (c + 12).alias("hi")))
    return t.catalog.select("global_id", F.inline(windows))


@query("window_distance", "SELECT a.query_id, a.rank, min(greatest(g.lo - a.frame_idx, a.frame_idx - g.hi, 0)) AS distance FROM run_a a JOIN gt g ON g.query_id = a.query_id AND g.video_id = a.video_id GROUP BY ALL")
def window_distance(t):
    gt = t.ground_truth.groupBy("query_id", "video_id").agg(F.collect_list(F.struct("lo", "hi")).alias("w"))  # a video's windows
    far = F.array_min(F.transform("w", lambda w: F.greatest(w["lo"] - F.col("frame_idx"), F.col("frame_idx") - w["hi"], F.lit(0))))
    return t.run("a").join(gt, ["query_id", "video_id"]).select("query_id", "rank", far.alias("distance"))


@query("l2_normalize", "SELECT global_id, round(sqrt(list_dot_product(v, v)), 6) AS before, 1.0 AS after FROM vectors")
def l2_norm(t):
    return t.vectors.select("global_id", F.round(norm(F.col("v")), 6).alias("before"), F.round(norm(l2_normalize(F.col("v"))), 6).alias("after"))


@query("mrl_truncate", "SELECT global_id, len(v) AS dim, round(v[1], 6) AS first, round(v[32], 6) AS last FROM lane32")
def mrl_truncate(t):
    v = t.vectors.select("global_id", truncate(F.col("v"), 32).alias("v"))
    return v.select("global_id", F.size("v").alias("dim"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(31)), 6).alias("last"))


@query("dhash_near_dup", """
WITH h AS (SELECT global_id, CAST('0x' || substr(md5(CAST(global_id % 40 AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM catalog), r AS (SELECT h, min(global_id) AS rep FROM h GROUP BY h)
SELECT rep AS a, global_id AS b FROM h JOIN r USING (h) WHERE global_id <> rep UNION ALL SELECT x.rep, y.rep FROM r x JOIN r y ON x.rep < y.rep AND bit_count(xor(x.h, y.h)) <= 5""")
def dhash_near_dup(t):
    """Hashes within 5 bits agree in one of six slices at least: an equi-join on slices, then the exact distance.

    Frames of equal hashes are rows with their representative (the smallest id); pairs are of representatives.
    """
    h = t.catalog.select("global_id", F.conv(F.substring(F.md5((F.col("global_id") % 40).cast("string")), 1, 15), 16, 10).cast("long").alias("h"))
    reps = h.groupBy("h").agg(F.min("global_id").alias("rep"))
    copies = h.join(reps, "h").where("global_id <> rep").select(F.col("rep").alias("a"), F.col("global_id").alias("b"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("h", 10 * k).bitwiseAND(1023).alias("p")) for k in range(6)])
    each = reps.select("h", "rep", F.explode(parts).alias("s"))
    near = each.select(F.col("rep").alias("a"), F.col("h").alias("ha"), "s").join(each.select(F.col("rep").alias("b"), F.col("h").alias("hb"), "s"), "s")
    near = near.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= 5)).select("a", "b").distinct()
    return copies.unionByName(near)


@query("parse_llm_json", "SELECT global_id, round(least(greatest(x, 0), 10), 6) AS first, 3::BIGINT AS n FROM (SELECT global_id, global_id / 20.0 - 3 AS x FROM catalog WHERE global_id % 5 <> 0)")
def parse_llm_json(t):
    x = F.col("global_id") / 20.0 - 3
    said = F.when(F.col("global_id") % 5 == 0, "no scores").otherwise(F.concat(F.lit("```json\n["), x, F.lit(", 5, 11]\n```")))
    got = t.catalog.select("global_id", parsing.llm_scores(said, 3).alias("s")).where("s is not null")
    return got.select("global_id", F.round(F.get("s", F.lit(0)), 6).alias("first"), F.size("s").alias("n"))


@query("cache_key", "SELECT item_id, substr(sha256('v1|' || text), 1, 24) AS key FROM benchmark")
def cache_key(t):
    return t.raw("benchmark").select("item_id", text.cache_key(F.lit("v1"), F.col("text")).alias("key"))


_ERRORS = ("503 UNAVAILABLE", "504 deadline exceeded", "429 quota", "request timed out", "HTTP 404 not found", "strange")


@query("classify_error", f"SELECT event_id, ['503', '504', '429', 'timeout', '4xx', 'other'][event_id % 6 + 1] AS kind FROM events")
def classify_error(t):
    said = F.get(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 6).cast("int"))
    return t.raw("events").select("event_id", text.classify_error(said).alias("kind"))


@query("pick_shot_frames", "SELECT DISTINCT global_id, CAST(frame_idx + round_even(49 * p, 0) AS BIGINT) AS frame FROM catalog, (VALUES (0.15::DOUBLE), (0.5::DOUBLE), (0.85::DOUBLE)) AS v(p)")
def pick_shot_frames(t):
    shots = t.catalog.select("global_id", F.col("frame_idx").alias("a"), (F.col("frame_idx") + 49).alias("b"))
    return parsing.shot_frames(shots, ["global_id"])


@query("refinement_window", "SELECT global_id, unnest(range(greatest(frame_idx - 2, 10), least(frame_idx + 2, 2000) + 1)) AS frame FROM catalog WHERE frame_idx + 2 >= 10 AND frame_idx - 2 <= 2000")
def refinement_window(t):
    lo, hi = F.greatest(F.col("frame_idx") - 2, F.lit(10)), F.least(F.col("frame_idx") + 2, F.lit(2000))
    return t.catalog.where(hi >= lo).select("global_id", F.explode(F.sequence(lo, hi)).alias("frame"))
