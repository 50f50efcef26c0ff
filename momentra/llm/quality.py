"""Quality rules by distribution divergence (DataFrame functions only).

Base rules count words, symbols, duplicate lines and repeated 8-word windows. The divergence rules
compare two histograms of a document with its language's reference by Jensen-Shannon distance (base
2, 0 to 1): character classes, and the language's commonest words (with the rest as one class). The
references are a stored table that a caller passes on from batch to batch, or else the pooled
histograms of those documents of the language that pass the base rules and are long enough to judge,
so junk and boilerplate do not shape them. A language without a reference (none of its documents is
fit) or word list is not compared by it. Texts below a minimum length are too short to judge by a
histogram and are held to the base rules only. Features are computed once and written.

Defined cases: null and empty texts have no words and fail the base rules; a null language is one
more language (''); repeated rows and rows with a null ``doc_id`` are judged each on its own; an empty
table gives no rows; ``filtered`` passes further columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

# Common words of each language, most frequent first.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "on", "as", "are", "be"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "dans", "par", "sur"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "las", "un", "por", "con", "no", "una", "para", "es"),
}
_SPLIT = r"[\x20\x09-\x0D]+"
# Character classes, each the characters removed by its pattern.
_CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", r"[\x20\x09-\x0D]+", r"[.,;:!?'\"()\-]+", r"[#*$%&|<>]+")
_SPACES, _SYMBOLS = 3, 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once a row even where ``body`` loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(windows: Column, size: int = 8) -> Column:
    """Words inside windows of ``size`` words that occur twice or more, by the windows' hashes."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        spans = _let(pairs, positions)
        # words covered by sorted windows: the step to the next one, at most a window
        return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("end")), lambda a, i: F.struct((a["n"] + (i + size - F.greatest(i, a["end"])).cast("long")).alias("n"), (i + size).alias("end")), lambda a: a["n"])

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(windows, covered))


def _doubled(name: str, step: int) -> Column:
    """Hashes of runs twice as long: each with the one ``step`` positions on (the tail pairs with null)."""
    return F.zip_with(F.col(name), F.slice(F.col(name), F.lit(step + 1), F.size(name)), lambda a, b: F.xxhash64(a, b))


def _letter(list_of: str, codes: str, word: Column) -> Column:
    at = F.call_function("instr", F.lit(list_of), F.concat(F.lit(" "), word, F.lit(" ")))
    return F.substring(F.lit(codes), F.greatest(at, F.lit(1)), F.lit(1))


def _letter_counts(letters: tuple, text: Column) -> Column:
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in letters])


def _common_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, then of all other words; empty for other languages.

    Each word becomes one letter (its place in the list, '.' for any other), so that a text is a
    short string whose letters are counted.
    """
    out = F.when(F.lit(False), F.array().cast("array<double>"))
    for name, common in COMMON.items():
        letters = [chr(ord("a") + k) for k in range(len(common))]
        list_of = "." + "".join(f" {w}" for w in common) + " "
        code_at = list(" " * len(list_of))
        code_at[0], at = ".", 1
        for w, c in zip(common, letters, strict=True):
            code_at[at], at = c, at + len(w) + 1
        codes = "".join(code_at)
        coded = F.array_join(F.transform(words, partial(_letter, list_of, codes)), "")
        out = out.when(lang == name, _let(coded, partial(_letter_counts, (*letters, "."))))
    return out.otherwise(F.array().cast("array<double>"))


def features(docs: DataFrame, carry: Column) -> DataFrame:
    """``row`` (``carry``), ``l`` and every count and histogram: one pass over the texts.

    Steps are projections of their own, so that what a later one uses twice is computed once.
    """
    told = docs.select(carry.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("l"))
    kept, rest = ["row", "l", "t"], "t"
    told = told.withColumn("s0", F.length("t"))
    kept.append("s0")
    for k, pattern in enumerate(_CLASSES, 1):  # each pattern is removed from what the one before left
        told = told.select(*kept, F.regexp_replace(rest, pattern, "").alias("r"))
        told = told.select(*kept, "r", F.length("r").alias(f"s{k}"))
        kept.append(f"s{k}")
        rest = "r"
    sizes = [F.col(f"s{k}") for k in range(len(_CLASSES) + 1)]
    chars = [(a - b).cast("double") for a, b in zip(sizes, [*sizes[1:], F.lit(0)], strict=True)]
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.filter(F.split(F.lower("t"), r"[^\p{L}]+"), lambda w: w != "")
    told = told.select("row", "l", F.col("s0").alias("n_code_points"), F.array(*chars).alias("hc"), F.split("t", _SPLIT).alias("ws"), lines.alias("lines"), letters.alias("lw"))
    told = told.withColumn("ws", F.filter("ws", lambda w: w != ""))
    told = told.select("row", "l", "n_code_points", "hc", F.size("ws").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _common_counts(F.col("lw"), F.col("l")).alias("hw"), F.transform("ws", lambda w: F.xxhash64(w)).alias("h"))
    for step in (1, 2, 4):
        told = told.withColumn("h", _doubled("h", step))
    told = told.withColumn("h", F.when(F.size("h") >= 8, F.slice("h", F.lit(1), F.size("h") - 7)).otherwise(F.array().cast("array<bigint>")))
    told = told.select("row", "l", "n_code_points", "hc", "n_words", "n_dup_lines", "hw", _repeat_words(F.col("h")).alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return told.withColumn("word_chars", (F.col("n_code_points") - F.get("hc", F.lit(_SPACES))).cast("long")).withColumn("n_symbols", F.get("hc", F.lit(_SYMBOLS)).cast("long")).withColumn("base_failed", failed)


def _shares(counts: Column) -> Column:
    return _let(counts, lambda c: _let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two share arrays; null if one is empty."""
    def term(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(p) > 0) & (F.size(q) > 0), F.sqrt(F.greatest(total, F.lit(0.0))))


def references(told: DataFrame, least_chars: int = 400, least_words: int = 100) -> DataFrame:
    """``ref_lang, ref_chars, ref_words``: pooled shares of ``features`` rows of each language that are fit to judge by."""
    longest = max(map(len, COMMON.values())) + 1
    fit = told.where(~F.col("base_failed") & (F.col("n_code_points") >= least_chars) & (F.col("n_words") >= least_words))
    sums = fit.groupBy(F.col("l").alias("ref_lang")).agg(*[F.sum(F.get("hc", F.lit(k))).alias(f"c{k}") for k in range(len(_CLASSES) + 1)], *[F.sum(F.get("hw", F.lit(k))).alias(f"w{k}") for k in range(longest)])
    words = F.filter(F.array(*[F.col(f"w{k}") for k in range(longest)]), lambda x: x.isNotNull())
    return sums.select("ref_lang", _shares(F.array(*[F.col(f"c{k}") for k in range(len(_CLASSES) + 1)])).alias("ref_chars"), _shares(words).alias("ref_words"))


@shared.tidied
def judged(docs: DataFrame, carry: Column, stored: DataFrame | None = None, most_chars: float = 0.2, most_words: float = 0.3, least_chars: int = 400, least_words: int = 100) -> DataFrame:
    """``row`` (``carry``) with base counts, both distances and the verdict ``kept`` beside it.

    What is carried, counts and histograms are written once; references (unless ``stored`` has them)
    are sums over that table, and verdicts need no text.
    """
    told = shared.written(features(docs, carry), "features")
    refs = stored if stored is not None else shared.written(references(told, least_chars, least_words), "references")
    if refs.count() <= 10_000:  # a few hundred bytes a language
        refs = F.broadcast(refs)
    held = told.join(refs, F.col("l") == F.col("ref_lang"), "left")
    held = held.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_code_points", js_distance(_shares(F.col("hc")), F.col("ref_chars")).alias("char_distance"), js_distance(_shares(F.col("hw")), F.col("ref_words")).alias("word_distance"))
    apart = ((F.col("n_code_points") >= least_chars) & (F.coalesce("char_distance", F.lit(0.0)) > most_chars)) | ((F.col("n_words") >= least_words) & (F.coalesce("word_distance", F.lit(0.0)) > most_words))
    return held.withColumn("kept", ~F.col("base_failed") & ~apart)


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return judged(docs, row, **options).where("kept").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_quality(spark, sf_dir: str) -> DataFrame:
    out = judged(shared.table(spark, sf_dir, "documents"), F.col("doc_id"))
    return out.select(F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def _op8_sql(most_chars: float = 0.2, most_words: float = 0.3, least_chars: int = 400, least_words: int = 100) -> str:
    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    rest, sizes = "t", ["length(t)"]
    for pattern in _CLASSES:
        rest = f"regexp_replace({rest}, {quoted(pattern)}, '', 'g')"
        sizes.append(f"length({rest})")
    n = len(_CLASSES)
    lists = " ".join(f"WHEN {quoted(name)} THEN [{', '.join(quoted(w) for w in common)}]" for name, common in COMMON.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l FROM documents),
base AS (
  SELECT rid, doc_id, t, l, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    [{', '.join(sizes)}, 0] AS s, CASE l {lists} END AS common,
    list_filter(string_split(regexp_replace(lower(t), '[^\p{{L}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS lw FROM d),
wins AS (SELECT rid, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM base WHERE len(ws) >= 8)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(0, 8) AS r(k) GROUP BY rid),
hist AS (
  SELECT *, list_transform(range(1, {n + 2}), lambda k: CAST(s[k] - s[k + 1] AS DOUBLE)) AS c,
    CASE WHEN common IS NULL THEN [] ELSE list_concat(list_transform(common, lambda w: CAST(len(list_filter(lw, lambda x: x = w)) AS DOUBLE)),
      [CAST(len(list_filter(lw, lambda x: NOT list_contains(common, x))) AS DOUBLE)]) END AS w FROM base),
each AS (
  SELECT *, CASE WHEN list_sum(c) > 0 THEN list_transform(c, lambda x: x / list_sum(c)) ELSE list_transform(c, lambda x: 0.0) END AS hc,
    CASE WHEN len(w) > 0 AND list_sum(w) > 0 THEN list_transform(w, lambda x: x / list_sum(w)) ELSE list_transform(w, lambda x: 0.0) END AS hw FROM hist),
fit AS (
  SELECT hist.* FROM hist LEFT JOIN covered ON hist.rid = covered.rid
  WHERE len(ws) >= {least_words} AND length(t) >= {least_chars} AND 100 * coalesce(covered.n, 0) <= 30 * len(ws) AND len(ws) >= 20),
cells AS (SELECT l, 'c' AS kind, unnest(c) AS v, generate_subscripts(c, 1) AS k FROM fit UNION ALL SELECT l, 'w', unnest(w), generate_subscripts(w, 1) FROM fit),
sums AS (SELECT l, kind, k, sum(v) AS v FROM cells GROUP BY ALL),
refs AS (SELECT l, kind, list(CASE WHEN total > 0 THEN v / total ELSE 0 END ORDER BY k) AS q FROM (SELECT *, sum(v) OVER (PARTITION BY l, kind) AS total FROM sums) GROUP BY l, kind),
far AS (
  SELECT each.*, sqrt(greatest(0, list_sum(list_transform(range(1, len(hc) + 1), lambda k: (CASE WHEN hc[k] > 0 THEN hc[k] * log2(hc[k] / ((hc[k] + rc.q[k]) / 2)) ELSE 0 END + CASE WHEN rc.q[k] > 0 THEN rc.q[k] * log2(rc.q[k] / ((hc[k] + rc.q[k]) / 2)) ELSE 0 END) / 2)))) AS dc,
    sqrt(greatest(0, list_sum(list_transform(range(1, len(hw) + 1), lambda k: (CASE WHEN hw[k] > 0 THEN hw[k] * log2(hw[k] / ((hw[k] + rw.q[k]) / 2)) ELSE 0 END + CASE WHEN rw.q[k] > 0 THEN rw.q[k] * log2(rw.q[k] / ((hw[k] + rw.q[k]) / 2)) ELSE 0 END) / 2)))) AS dw
  FROM each LEFT JOIN refs rc ON rc.l = each.l AND rc.kind = 'c' LEFT JOIN refs rw ON rw.l = each.l AND rw.kind = 'w'),
told AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len(ws) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(ws) AS base_failed, length(t) AS points, dc, dw
  FROM far LEFT JOIN covered ON far.rid = covered.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (points >= {least_chars} AND coalesce(dc, 0) > {most_chars}) AND NOT (n_words >= {least_words} AND coalesce(dw, 0) > {most_words}) AS kept,
  round(dc, 6) AS char_distance, round(dw, 6) AS word_distance
FROM told
"""


OP8_SQL = _op8_sql()
