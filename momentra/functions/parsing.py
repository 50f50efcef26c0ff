"""Query texts and small formats: clauses, events, questions, deadlines, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that split a query, and where in time the context then lies.
MARKERS = ((r"(?iu)(?<![\p{L}\p{N}_])(?:ngay\s+)?sau\s+khi(?![\p{L}\p{N}_])", "before"), (r"(?iu)(?<![\p{L}\p{N}_])(?:ngay\s+)?trư[ớo]c\s+khi(?![\p{L}\p{N}_])", "after"), (r"(?i)\bafter\b", "before"), (r"(?i)\bbefore\b", "after"))
SEQUENCE_CUES = "bắt đầu|kết thúc|sau đó|tiếp theo|cuối cùng|lần lượt|trước khi|sau khi|chuyển sang|chuyển cảnh"
EVENT = r"^\s*[Ee]\d{1,2}\s*(?:[:.)\-]\s*|\s+)"
QUESTION = r"(?<![\p{L}\p{N}_])(?:Câu hỏi|Câu Hỏi|CÂU HỎI|Hỏi|HỎI)(?![\p{L}\p{N}_])\s*[:,]?\s*"


def split_temporal(queries: DataFrame, least: int = 12) -> DataFrame:
    """Adds ``target, context, direction``; null unless both clauses of the first marker are long enough."""
    parts = F.lit(None).cast("struct<target:string,context:string,direction:string>")
    for pattern, direction in reversed(MARKERS):
        both = F.split("text", pattern, 2)
        target, context = F.trim(F.get(both, F.lit(0))), F.trim(F.get(both, F.lit(1)))
        ok = F.col("text").rlike(pattern)
        good = (F.length(target) >= least) & (F.length(context) >= least)
        parts = F.when(ok & good, F.struct(target.alias("target"), context.alias("context"), F.lit(direction).alias("direction"))).when(ok, F.lit(None)).otherwise(parts)
    return queries.withColumn("parts", parts).select("*", "parts.target", "parts.context", "parts.direction").drop("parts")


def trake_events(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``event_idx, event`` of an event list; with two marked lines or more, unmarked ones are headers."""
    own = Window.partitionBy(*keys)
    told = lines.withColumn("marked", F.col("line").rlike(EVENT)).withColumn("n", F.count_if("marked").over(own)).where("marked or n < 2")
    told = told.withColumn("event", F.trim(F.regexp_replace("line", EVENT, ""))).where("event <> ''")
    return told.select(*keys, (F.row_number().over(own.orderBy("line_no")) - 1).alias("event_idx"), "event")


def split_qa(queries: DataFrame) -> DataFrame:
    """``context, question``: after the last marker, else the last sentence that asks."""
    pieces = F.split("text", QUESTION)
    marked = F.size(pieces) > 1
    sentences = F.split("text", r"(?<=[.!?])\s+")
    last = F.element_at(sentences, -1)
    asks = last.endswith("?")
    context = F.when(marked, F.trim(F.substr("text", F.lit(1), F.length("text") - F.length(F.element_at(F.regexp_extract_all("text", F.lit(QUESTION), F.lit(0)), -1)) - F.length(F.element_at(pieces, -1)))))
    context = context.when(asks, F.trim(F.substr("text", F.lit(1), F.length("text") - F.length(last)))).otherwise(F.col("text"))
    question = F.when(marked, F.trim(F.element_at(pieces, -1))).when(asks, last).otherwise("")
    return queries.select("*", context.alias("context"), question.alias("question"))


def kis_events(queries: DataFrame, most: int = 6, words: int = 6) -> DataFrame:
    """Adds ``events``: sentences of some length, if three or more, or two with a sequence cue."""
    sentences = F.filter(F.transform(F.split(F.trim("text"), r"(?<=[.!?])\s+"), F.trim), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= words)
    some = (F.size(sentences) >= 3) | ((F.size(sentences) == 2) & F.lower("text").rlike(SEQUENCE_CUES))
    return queries.select("*", F.when(some, F.slice(sentences, 1, most)).otherwise(F.array().cast("array<string>")).alias("events"))


def minutes_until(hhmm: Column, now: Column, shift: int) -> Column:
    """Minutes from ``now`` (shifted to local time) to a clock time, within twelve hours either way."""
    close = F.split_part(hhmm, F.lit(":"), F.lit(1)).cast("long") * 60 + F.split_part(hhmm, F.lit(":"), F.lit(2)).cast("long")
    left = close - (F.hour(now) * 60 + F.minute(now) + shift) % 1440
    return F.when(left < -720, left + 1440).when(left > 720, left - 1440).otherwise(left)


def governed(left: Column, floor: float = 5.0, reserve: float = 25.0, share: float = 0.45) -> Column:
    return F.greatest(F.lit(floor), (left - reserve) * share)


def llm_scores(said: Column, n: int) -> Column:
    """Scores of a JSON list, possibly in a code fence, clamped to 0..10; null unless there are ``n``."""
    scores = F.from_json(F.regexp_extract(said, r"\[[^\]]*\]", 0), "array<double>")
    return F.when(F.size(scores) == n, F.transform(scores, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(10.0))))


def shot_frames(shots: DataFrame, keys: list[str], at=(0.15, 0.5, 0.85)) -> DataFrame:
    """Distinct frames at the given shares of each shot ``a..b`` (half to even)."""
    frames = F.array_distinct(F.array(*[(F.col("a") + F.bround((F.col("b") - F.col("a")) * F.lit(p)).cast("long")) for p in at]))
    return shots.select(*keys, F.explode(frames).alias("frame"))
