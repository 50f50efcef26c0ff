"""BM25 over documents that belong to keys: statistics, postings, and candidate scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources import store


def _each(tokens: str = "tokens"):
    """One row a token. Of a bare column Spark would infer a filter, and part every text a second time for it."""
    return F.explode(F.when(F.size(tokens) > 0, F.col(tokens))).alias("token")


def postings(docs: DataFrame) -> DataFrame:
    """``key, doc_no, token, tf, dl`` from ``docs (key, doc_no, text)``; texts without tokens vanish."""
    words = docs.select("key", "doc_no", tokenize(F.col("text")).alias("tokens"))
    rows = words.select("key", "doc_no", F.size("tokens").alias("dl"), _each())
    return rows.groupBy("key", "doc_no", "dl", "token").agg(F.count("*").alias("tf"))


def statistics(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(df by token, one row of n_docs and avgdl)``: documents count, not keys."""
    df = posted.groupBy("token").agg(F.count("*").alias("df"))
    lengths = posted.groupBy("key", "doc_no").agg(F.first("dl").alias("dl"))
    return df, lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def asked(queries: DataFrame) -> DataFrame:
    """A query's tokens with the times they occur in it."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def score_postings(posted: DataFrame, df: DataFrame, totals: DataFrame, asked: DataFrame, candidates: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, least: float = 1e-9) -> DataFrame:
    """``query_id, key, score``: a key's best document; a query token counts as often as it occurs.

    ``posted`` needs the query tokens' postings only; ``df`` and the one row of ``totals`` are those of
    the whole corpus. With ``candidates (query_id, key)`` only those pairs are scored.
    """
    if candidates is None:
        hits = posted.join(asked, "token")
    else:
        hits = posted.join(candidates.select("query_id", "key").distinct(), "key").join(asked, ["query_id", "token"])
    hits = hits.join(df, "token").join(F.broadcast(totals))
    idf = F.log((F.col("n_docs") + 1) / F.col("df"))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")) + F.col("tf"))
    each = hits.groupBy("query_id", "key", "doc_no").agg(F.sum(part).alias("score"))
    return each.groupBy("query_id", "key").agg(F.max("score").alias("score")).where(F.col("score") > least)


def score(docs: DataFrame, queries: DataFrame, candidates: DataFrame | None = None, **params) -> DataFrame:
    """Scores of ``docs (key, doc_no, text)`` for a batch of ``queries (query_id, text)``.

    Tokens that no query asks for are dropped before anything is shuffled; lengths need no shuffle.
    """
    tokens = asked(queries)
    if candidates is not None and docs.groupBy("key", "doc_no").count().where("count > 1").isEmpty():
        return _score_candidates(docs, tokens, candidates, **params)
    words = docs.select("key", "doc_no", tokenize(F.col("text")).alias("tokens"))
    length = words.select(F.size("tokens").alias("dl")).select(F.when(F.col("dl") > 0, F.col("dl")).alias("dl"))
    totals = length.agg(F.count("dl").alias("n_docs"), F.avg("dl").alias("avgdl"))
    each = words.select("key", "doc_no", F.size("tokens").alias("dl"), _each()).join(tokens.select("token").distinct(), "token", "left_semi")
    posted = each.groupBy("key", "doc_no", "dl", "token").agg(F.count("*").alias("tf"))
    df = posted.groupBy("token").agg(F.count("*").alias("df"))
    return score_postings(posted, df, totals, tokens, candidates, **params)


def _score_candidates(docs: DataFrame, asked: DataFrame, candidates: DataFrame, **params) -> DataFrame:
    """Scores of candidate pairs over ``docs`` of which each is one row.

    One pass over all documents counts for each asked token the documents that hold it, combined before
    the shuffle; the empty token, which no text has, stands for the document itself. Only the candidates'
    own documents get postings.
    """
    vocabulary = asked.select("token").union(asked.sparkSession.createDataFrame([("",)], "token string")).distinct()
    words = docs.select(tokenize(F.col("text")).alias("tokens"))
    own = F.when(F.size("tokens") > 0, F.array_append(F.array_distinct("tokens"), F.lit("")))
    each = words.select(F.size("tokens").alias("dl"), F.explode(own).alias("token")).join(vocabulary, "token", "left_semi")
    counts = store.written(each.groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("words")), "text-counts")
    totals = counts.where("token = ''").select(F.col("df").alias("n_docs"), (F.col("words") / F.col("df")).alias("avgdl"))
    pairs = candidates.select("query_id", "key").distinct().join(asked.select("query_id").distinct(), "query_id", "left_semi")
    pairs = store.written(pairs, "text-pairs")  # a table of known size, so that texts are not dealt out for the join
    near = docs.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "doc_no", tokenize(F.col("text")).alias("tokens"))
    posted = near.select("key", "doc_no", F.size("tokens").alias("dl"), _each()).groupBy("key", "doc_no", "dl", "token").agg(F.count("*").alias("tf"))
    return score_postings(posted, counts.where("token <> ''").select("token", "df"), totals, asked, pairs, **params)
