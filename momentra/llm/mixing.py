"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token totals by (source, language, topic) are raked until their source, language and topic marginals
meet the targets. A document is kept with its cell's probability, raked tokens over given tokens
scaled so that the largest is 1; the draw is a digest of its id, so it never depends on the layout.

Targets are shares of tokens. Languages and topics have stated shares; sources, whose names differ
from corpus to corpus, get their own share to a stated power, so that a source of a third of all
tokens shrinks and small ones grow. The topic of a document is the one of which most phrases occur in
its whole text.

The cell table has one row a combination of categories that occurs, whatever the number of documents.
Rounds end when all marginals meet their targets; if they can't (a target asks for what no document
has), they end after ``rounds`` and ``fit`` tells the residual of each cell's categories.

Defined cases: null text has no tokens; null source, language or topic is the category ''; a category
without a stated target keeps its own share in a column that states some; targets of categories that
do not occur are left out and the others scaled to 1; a cell without tokens keeps its documents (they weigh nothing); equal
ids draw alike; a null id draws as ''; an empty table gives no rows; ``sample`` passes further columns
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

_NAMES = ("source", "lang", "topic")

# Topics and the phrases (lower case) that tell them; more phrases win, the first of equals.
TOPICS = (
    ("legal", ("licensed under", "released under", "general public license", "copyright", "warrant", "liabilit", "contract", "court")),
    ("table", (" | ", "|--", "\t")),
    ("contact", ("@", "http://", "https://", "www.")),
    ("technology", ("software", "comput", "server", "database", "algorithm", "internet")),
    ("science", ("experiment", "hypothes", "molecul", "physic", "galax", "theorem")),
    ("health", ("patient", "hospital", "medic", "disease", "symptom", "vaccin")),
    ("finance", ("invest", "market", "financ", "revenue", "inflation", "shareholder")),
    ("news", ("president", "minister", "parliament", "election", "government", "police")),
)
#: Stated shares of tokens.
TARGETS = {
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12},
    "topic": {"prose": 0.9, "table": 0.04, "legal": 0.035, "contact": 0.02},
}


def topic_of(low: Column, topics=TOPICS) -> Column:
    """The topic of which most phrases occur in the whole lower-case text, 'prose' where none does."""
    counts = [(name, sum((low.contains(p).cast("int") for p in phrases[1:]), low.contains(phrases[0]).cast("int"))) for name, phrases in topics]
    best = F.greatest(*[c for _, c in counts], F.lit(0))
    out = F.lit("prose")
    for name, c in reversed(counts):
        out = F.when(c == best, F.lit(name)).otherwise(out)
    return F.when(best == 0, F.lit("prose")).otherwise(out)


def token_count(text: Column) -> Column:
    """White-space tokens: runs outside ``\\x20\\x09-\\x0D``."""
    edge = lambda c: c.rlike(r"^[\x20\x09-\x0D]$").cast("int")
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+")) - edge(F.left(text, F.lit(1))) - edge(F.right(text, F.lit(1)))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), pieces).otherwise(0).cast("long")


def fit(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.8, rounds: int = 60, tolerance: float = 1e-10, small: int = 200_000) -> DataFrame:
    """Rakes ``cells (source, lang, topic, tokens)``: adds ``fitted``, whose marginals are the targets, and ``residual``.

    A category's target share is ``targets[column][category]``, or else its share of tokens, to the
    ``power`` in a column without any target; shares are scaled to 1 in each column. ``residual`` is the largest relative distance of
    a cell's three marginals from their targets when the rounds ended. Up to ``small`` cells are one
    partition, more are dealt by the category of each step.
    """
    goal = cells.where("tokens > 0")
    if goal.count() <= small:
        goal = goal.coalesce(1)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    of = {name: Window.partitionBy(name).orderBy(*_NAMES).rowsBetween(*every) for name in _NAMES}
    for name in _NAMES:
        stated = (TARGETS if targets is None else targets).get(name) or {}
        given = F.create_map(*[F.lit(x) for kv in (stated or {"\0": 0.0}).items() for x in kv])
        shares = goal.groupBy(name).agg(F.sum("tokens").alias("own"))
        shares = shares.select(name, F.coalesce(F.try_element_at(given, F.col(name)), F.pow(F.col("own") / total, F.lit(1.0 if stated else power))).alias("raw"))
        whole = float(shares.agg(F.sum("raw")).first()[0] or 1)
        goal = goal.join(shares.select(name, (F.col("raw") / whole * total).alias(f"goal_{name}")), name)
    fitted = goal.select(*_NAMES, "tokens", *[f"goal_{n}" for n in _NAMES], F.col("tokens").cast("double").alias("fitted"), F.lit(0.0).alias("residual"))
    distance = F.greatest(*[F.abs(F.sum("fitted").over(of[n]) / F.col(f"goal_{n}") - 1) for n in _NAMES])
    for n in range(rounds):
        for name in _NAMES:
            fitted = fitted.withColumn("fitted", F.col("fitted") * F.col(f"goal_{name}") / F.sum("fitted").over(of[name]))
        if n % 5 == 4 or n == rounds - 1:
            before, fitted = fitted, shared.written(fitted.withColumn("residual", distance), "raked")
            shared.forget(before)
            if (fitted.agg(F.max("residual")).first()[0] or 0) <= tolerance:
                break
    return fitted


@shared.tidied
def probabilities(docs: DataFrame, carry: Column, targets=None, power: float = 0.8, rounds: int = 60, topics=TOPICS) -> DataFrame:
    """``row`` (``carry``), ``source, lang, topic, n_tokens, probability, selected`` of every row.

    What is carried and told of a text is written once; the draw needs no text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    told = docs.select(carry.alias("row"), key.alias("key"), name("source").alias("source"), name("lang").alias("lang"), text.alias("text"), F.lower(text).alias("low"))
    told = shared.written(told.select("row", "key", "source", "lang", topic_of(F.col("low"), topics).alias("topic"), token_count(F.col("text")).alias("n_tokens")), "told")
    cells = shared.written(told.groupBy(*_NAMES).agg(F.sum("n_tokens").alias("tokens")), "cells")
    ratio = fit(cells, targets, power, rounds).withColumn("ratio", F.col("fitted") / F.col("tokens"))
    most = ratio.agg(F.max("ratio")).first()[0] or 1.0
    ratio = ratio.select(*_NAMES, F.round(F.col("ratio") / most, 9).alias("probability"))
    if ratio.count() <= 200_000:  # a few dozen bytes a cell
        ratio = F.broadcast(ratio)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), "key")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    out = told.join(ratio, [*_NAMES], "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.select("row", *_NAMES, "n_tokens", "probability", (drawn < F.col("probability")).alias("selected"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return probabilities(docs, row, **options).where("selected").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    out = probabilities(shared.table(spark, sf_dir, "documents"), F.col("doc_id"))
    return out.select(F.col("row").alias("doc_id"), *_NAMES, "n_tokens", F.round("probability", 6).alias("probability"), "selected")


def _op4_sql(power: float = 0.8, rounds: int = 60) -> str:
    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    def count(phrases):
        return " + ".join(f"CAST(contains(low, {quoted(p) if p.isprintable() else f'chr({ord(p)})'}) AS INTEGER)" for p in phrases)

    counts = ", ".join(f"{count(ps)} AS c{i}" for i, (_, ps) in enumerate(TOPICS))
    best = f"greatest({', '.join(f'c{i}' for i in range(len(TOPICS)))})"
    case = " ".join(f"WHEN c{i} = {best} THEN {quoted(n)}" for i, (n, _) in enumerate(TOPICS))
    steps = []
    last = "c0"
    for n in range(rounds):
        for name in _NAMES:
            now = f"c{n}_{name}"
            steps.append(f"{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, g_source, g_lang, g_topic, f * g_{name} / sum(f) OVER (PARTITION BY {name}) AS f FROM {last})")
            last = now

    def raw(name):
        stated = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in TARGETS.get(name, {}).items())
        own = f"pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {1.0 if stated else power})"
        return f"CASE {name} {stated} ELSE {own} END" if stated else own

    shares = " ".join(f"JOIN (SELECT {n}, r / sum(r) OVER () AS s FROM (SELECT {n}, {raw(n)} AS r FROM cells WHERE tokens > 0 GROUP BY {n})) AS t_{n} ON cells.{n} = t_{n}.{n}" for n in _NAMES)
    goals = ", ".join(f"t_{n}.s * (SELECT sum(tokens) FROM cells) AS g_{n}" for n in _NAMES)
    return rf"""
WITH counted AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {counts}, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents)),
told AS (SELECT doc_id, source, lang, CASE WHEN {best} = 0 THEN 'prose' {case} END AS topic, n_tokens FROM counted),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM told GROUP BY ALL),
c0 AS MATERIALIZED (SELECT cells.*, {goals}, tokens AS f FROM cells {shares} WHERE tokens > 0),
{', '.join(steps)},
p AS (SELECT source, lang, topic, round(f / tokens / max(f / tokens) OVER (), 9) AS p FROM {last})
SELECT told.doc_id, told.source, told.lang, told.topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(coalesce(p, 1.0), 6) AS probability,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(p, 1.0) AS selected
FROM told LEFT JOIN p ON told.source = p.source AND told.lang = p.lang AND told.topic = p.topic
"""


OP4_SQL = _op4_sql()
