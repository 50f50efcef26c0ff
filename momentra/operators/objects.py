"""Soft object constraints over detections, and vocabulary matching of query nouns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Half planes of a box centre.
POSITIONS = {"left": "x < 0.45", "right": "x > 0.55", "center": "x between 0.30 and 0.70", "top": "y < 0.45", "bottom": "y > 0.55"}


def score(detections: DataFrame, constraints: list[tuple], floor: float = 0.3, key: str = "frame") -> DataFrame:
    """Mean credit over all constraints ``(entity, wanted count or None, position or None)`` per frame.

    One pass: every constraint is a conditional count of the same aggregation.
    """
    counts, credits = [], []
    for i, (entity, want, position) in enumerate(constraints):
        hit = (F.col("entity") == entity) & (F.col("score") >= floor)
        if position:
            hit = hit & F.expr(POSITIONS[position])
        counts.append(F.count_if(hit).alias(f"k{i}"))
        k = F.col(f"k{i}")
        some = F.lit(1.0) if want is None else F.when(k == want, 1.0).when(F.abs(k - want) == 1, 0.5).otherwise(0.2)
        credits.append(F.when(k == 0, 0.0).otherwise(some))
    total = credits[0]
    for c in credits[1:]:
        total = total + c
    return detections.groupBy(key).agg(*counts).select(key, (total / len(constraints)).alias("score"))


def concept_counts(detections: DataFrame, results: DataFrame, floor: float = 0.4, top: int = 10) -> DataFrame:
    """The commonest entities over a query's results."""
    hits = detections.where(F.col("score") >= floor).join(results, "frame")
    from .fusion import ranked

    counts = hits.groupBy("query_id", "entity").agg(F.count("*").alias("score")).withColumnRenamed("entity", "global_id")
    return ranked(counts, ["query_id"]).where(F.col("rank") <= top).select("query_id", F.col("global_id").alias("entity"), F.col("score").alias("n"), "rank")


# Number words in front of a noun.
COUNT_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "một": 1, "hai": 2, "ba": 3, "bốn": 4, "năm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9, "mười": 10}


def parse(queries: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``query_id, entity, want, position``: vocabulary nouns, longest first and without overlaps.

    An alternation ordered by length makes the pattern itself claim spans; a count is looked for in
    the three words before a noun, a position in the 24 characters around it.
    """
    import re

    nouns = "|".join(re.escape(w) for w in sorted(vocabulary, key=lambda w: (-len(w), w)))
    low = F.lower("text")
    numbers = F.create_map(*[F.lit(x) for k, v in COUNT_WORDS.items() for x in (k, v)])
    pattern = rf"((?:[\p{{L}}\p{{N}}]+\s+){{0,3}}?)(?<![\p{{L}}\p{{N}}_])({nouns})(?![\p{{L}}\p{{N}}_])"
    each = queries.select("query_id", "text", F.posexplode(F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("before"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("entity"))).alias("pos", "m"))
    words = F.reverse(F.slice(F.reverse(F.filter(F.split("m.before", r"\s+"), lambda x: x != "")), 1, 3))
    value = F.transform(words, lambda w: F.coalesce(w.try_cast("int"), F.try_element_at(numbers, w)))
    want = F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.filter(value, lambda v: v.between(1, 30))), -1)
    at = F.expr("locate(m.entity, lower(text))")
    around = F.substr(low, F.greatest(at - 24, F.lit(1)), F.length("m.entity") + 48)
    position = F.when(around.rlike("left|bên trái"), "left").when(around.rlike("right|bên phải"), "right").when(around.rlike("center|middle|ở giữa"), "center")
    return each.select("query_id", "pos", "m.entity", want.alias("want"), position.alias("position"))
