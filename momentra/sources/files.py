"""Readers and writers for the engine's file formats; bad rows are skipped, never fatal.

The parsing half of each reader works on string columns, so it serves tables and streams too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_invisible

VIDEO_ID = r"^[A-Z]\d{2}_V\d{3}$"
LONG_ID = r"^[A-Z]\d{2,}_V\d{3}$"  # of a corpus with more than 99 batches


def int_of(c: Column) -> Column:
    """A whole number that may be written as a decimal; null if it is neither."""
    return c.try_cast("double").cast("bigint")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


# -- map tables -----------------------------------------------------------------------------
def parse_map_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """``n, pts_time, fps, frame_idx`` of comma-separated lines; malformed ones go."""
    parts = F.split(F.regexp_replace(F.col(line), "^﻿", ""), ",")
    rows = lines.select(*[c for c in lines.columns if c != line], int_of(F.get(parts, F.lit(0))).cast("int").alias("n"), F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("pts_time"), F.trim(F.get(parts, F.lit(2))).try_cast("double").alias("fps"), int_of(F.get(parts, F.lit(3))).alias("frame_idx"))
    return rows.dropna(subset=["n", "pts_time", "fps", "frame_idx"])


def read_map_csv(spark: SparkSession, path: str) -> DataFrame:
    """Keyframe maps, one CSV a video (named by it), header first."""
    lines = spark.read.text(path).select(_stem(F.col("_metadata.file_path")).alias("video_id"), F.col("value").alias("line"))
    return parse_map_rows(lines)


def build_manifest(files: DataFrame, maps: DataFrame, video: str = VIDEO_ID) -> DataFrame:
    """Keyframe files LEFT JOIN maps; ids are dense over (video_id, n). Files whose video is not named as ``video`` go.

    A file without a map row falls back to one frame a second. Ids are a running count of videos
    (one row each) plus a position inside the video, so no task sorts all rows.
    """
    from pyspark.sql import Window

    rows = files.where(F.col("video_id").rlike(video)).join(maps, ["video_id", "n"], "left")
    base = rows.groupBy("video_id").agg(F.count("*").alias("c"))
    base = base.select("video_id", (F.sum("c").over(Window.orderBy("video_id")) - F.col("c")).alias("base"))
    rows = rows.join(base, "video_id").withColumn("pos", F.row_number().over(Window.partitionBy("video_id").orderBy("n")) - 1)
    return rows.select((F.col("base") + F.col("pos")).alias("global_id"), "video_id", "n", F.coalesce("frame_idx", F.col("n") - 1).cast("bigint").alias("frame_idx"), F.coalesce("pts_time", (F.col("n") - 1).cast("double")).alias("pts_time"), F.coalesce("fps", F.lit(25.0)).alias("fps"), F.col("frame_idx").isNotNull().alias("has_map"))


# -- media information ------------------------------------------------------------------------
def parse_media_info(rows: DataFrame, text: str = "json") -> DataFrame:
    """Title, description, keywords (list, listed string or comma-separated) and blob of JSON strings."""
    shape = "struct<title:string,description:string,keywords:string,watch_url:string>"
    told = rows.withColumn("m", F.from_json(text, shape))
    raw = F.coalesce(F.col("m.keywords"), F.lit(""))
    listed = F.from_json(F.regexp_replace(raw, "'", '"'), "array<string>")
    words = F.when(raw.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.split(raw, r"\s*,\s*"))
    told = told.withColumn("keywords", F.filter(F.transform(words, F.trim), lambda x: x != ""))
    blob = F.trim(F.concat_ws(" ", F.col("m.title"), F.col("m.description"), F.concat_ws(" ", "keywords")))
    return told.select(*[c for c in rows.columns if c != text], F.coalesce("m.title", F.lit("")).alias("title"), F.coalesce("m.watch_url", F.lit("")).alias("watch_url"), "keywords", blob.alias("blob"))


def read_media_info(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("video_id"), F.col("value").alias("json"))
    return parse_media_info(rows)


# -- detections -------------------------------------------------------------------------------
def parse_detections(rows: DataFrame, text: str = "json") -> DataFrame:
    """One row a detection from JSON of parallel arrays (numbers may be strings)."""
    shape = "struct<detection_class_entities:array<string>,detection_scores:array<string>,detection_boxes:array<array<string>>>"
    keys = [c for c in rows.columns if c != text]
    told = rows.select(*keys, F.from_json(text, shape).alias("d"))
    each = told.select(*keys, "d", F.posexplode("d.detection_class_entities").alias("pos", "entity"))
    box = F.transform(F.coalesce(F.get("d.detection_boxes", F.col("pos")), F.array(*map(F.lit, "0011"))), lambda x: x.try_cast("double"))
    return each.select(*keys, "pos", "entity", F.coalesce(F.get("d.detection_scores", F.col("pos")).try_cast("double"), F.lit(0.0)).alias("score"), box.alias("box"))


def compact_detections(manifest: DataFrame, detections: DataFrame, floor: float = 0.3) -> DataFrame:
    """Detections at or over ``floor`` as arrays, total over the manifest (empty for misses)."""
    lists = detections.where(F.col("score") >= floor).groupBy("global_id").agg(F.array_sort(F.collect_list(F.struct("entity", "score"))).alias("objects"))
    return manifest.select("global_id").join(lists, "global_id", "left").withColumn("objects", F.coalesce("objects", F.array().cast("array<struct<entity:string,score:double>>")))


# -- query packs, runs, dumps, logs -------------------------------------------------------------
def query_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """``line_no, line`` of texts without invisible characters and blank lines."""
    keys = [c for c in rows.columns if c != text]
    each = rows.select(*keys, F.posexplode(F.split(strip_invisible(F.col(text)), "\r?\n")).alias("line_no", "line"))
    return each.select(*keys, "line_no", F.trim("line").alias("line")).where("line <> ''")


def read_query_pack(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text"))
    return query_lines(rows)


def parse_run_lines(rows: DataFrame, line: str = "line") -> DataFrame:
    """``video_id, frame_idx, answer`` of submission lines (quotes doubled inside quotes)."""
    told = F.from_csv(F.col(line), "video_id string, frame string, answer string", {"escape": '"'})
    keys = [c for c in rows.columns if c != line]
    return rows.select(*keys, told.alias("r")).select(*keys, F.trim("r.video_id").alias("video_id"), int_of(F.col("r.frame")).alias("frame_idx"), "r.answer")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A folder of header-less submission files: ``stem, rank`` and the row."""
    whole = spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("stem"), F.col("value"))
    lines = whole.select("stem", F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    return parse_run_lines(lines.select("stem", (F.col("pos") + 1).alias("rank"), "line"))


def parse_signal_dumps(rows: DataFrame, text: str = "json") -> DataFrame:
    """``signal, video_id, frame_idx, score`` of dumps ``{signal: {"video,frame": score}}``; corrupt ones go."""
    keys = [c for c in rows.columns if c != text]
    told = rows.select(*keys, F.explode(F.from_json(text, "map<string,map<string,double>>")).alias("signal", "scores"))
    each = told.select(*keys, "signal", F.explode("scores").alias("at", "score"))
    return each.select(*keys, "signal", F.split_part("at", F.lit(","), F.lit(1)).alias("video_id"), int_of(F.split_part("at", F.lit(","), F.lit(2))).alias("frame_idx"), "score")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


# -- ground truth -------------------------------------------------------------------------------
GT_SHAPE = "struct<task:string,video_id:string,range:array<long>,ranges:array<array<long>>,moments:array<array<long>>,center:long,epsilon:long,events:array<array<long>>,centers:array<long>,answers:array<string>,answer:string>"


def parse_ground_truth(rows: DataFrame, text: str = "json") -> DataFrame:
    """Canonical windows ``task, video_id, event_idx, lo, hi, answers`` of all accepted spellings.

    A trake entry keeps events that can't be read as null windows (certain misses); the other tasks'
    windows are alternatives.
    """
    keys = [c for c in rows.columns if c != text]
    told = rows.select(*keys, F.from_json(text, GT_SHAPE).alias("g"))
    eps = F.coalesce(F.col("g.epsilon"), F.lit(0))
    windows = F.coalesce(
        F.col("g.events"),
        F.transform(F.col("g.centers"), lambda c: F.array(c - eps, c + eps)),
        F.col("g.ranges"),
        F.col("g.moments"),
        F.when(F.col("g.range").isNotNull(), F.array(F.col("g.range"))),
        F.when(F.col("g.center").isNotNull(), F.array(F.array(F.col("g.center") - eps, F.col("g.center") + eps))),
    )
    sequence = F.col("g.events").isNotNull() | F.col("g.centers").isNotNull()
    task = F.coalesce(F.lower(F.col("g.task")), F.when(sequence, "trake").when(F.coalesce("g.answers", F.array("g.answer"))[0].isNotNull(), "qa").otherwise("kis"))
    answers = F.coalesce(F.col("g.answers"), F.when(F.col("g.answer").isNotNull(), F.array("g.answer")), F.array().cast("array<string>"))
    each = told.select(*keys, task.alias("task"), F.col("g.video_id").alias("video_id"), answers.alias("answers"), F.posexplode_outer(windows).alias("event_idx", "w"))
    ok = (F.size("w") == 2) & (F.get("w", F.lit(0)) <= F.get("w", F.lit(1)))
    return each.select(*keys, "task", "video_id", F.coalesce("event_idx", F.lit(0)).alias("event_idx"), F.when(ok, F.get("w", F.lit(0))).alias("lo"), F.when(ok, F.get("w", F.lit(1))).alias("hi"), "answers")


def check_ground_truth(gt: DataFrame) -> None:
    """Raises for entries without a video or any readable window (eager: a plan would tell too late)."""
    bad = gt.groupBy("query_id").agg(F.max(F.col("video_id").isNull()).alias("no_video"), F.max(F.col("lo").isNotNull()).alias("some")).where("no_video or not some").limit(5).collect()
    if bad:
        raise ValueError(f"ground truth without video or window: {[r['query_id'] for r in bad]}")


# -- sinks ----------------------------------------------------------------------------------------
def submission_lines(rows: DataFrame) -> DataFrame:
    """``query_id, rank, line``: header-less CSV lines of ranked rows (``frames`` array, optional answer)."""
    from ..functions.text import sanitize_answer

    cells = [F.col("video_id"), F.concat_ws(",", F.transform("frames", lambda x: x.cast("string")))]
    if "answer" in rows.columns:
        cells.append(sanitize_answer(F.col("answer")))
    return rows.select("query_id", "rank", F.concat_ws(",", *cells).alias("line"))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by ``key`` over all cores, by number: Spark would join these few bytes into one task, but the
    work of a writer is in its folders."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartitionById(n, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def write_submission(rows: DataFrame, path: str) -> None:
    """One folder a query with its lines in rank order (committed atomically)."""
    lines = _dealt(submission_lines(rows), "query_id").sortWithinPartitions("query_id", "rank")
    lines.select("query_id", "line").write.partitionBy("query_id").text(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, rank, line`` of what ``write_submission`` has written."""
    whole = spark.read.schema("value string, query_id long").text(path, wholetext=True)
    lines = whole.select("query_id", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("pos", "line"))
    return lines.select("query_id", (F.col("pos") + 1).alias("rank"), "line")


def write_map_csv(rows: DataFrame, path: str) -> None:
    """Maps as CSV with a header, one folder a video; negative frames are refused before anything is written."""
    if not rows.where("frame_idx < 0").isEmpty():
        raise ValueError("negative frame_idx")
    maps = rows.select("video_id", "n", "pts_time", "fps", "frame_idx")
    maps = _dealt(maps, "video_id").sortWithinPartitions("video_id", "n")
    maps.write.partitionBy("video_id").option("header", True).csv(path)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """``video_id, n, pts_time, fps, frame_idx`` of what ``write_map_csv`` has written."""
    return spark.read.schema("n int, pts_time double, fps double, frame_idx long, video_id string").option("header", True).csv(path)


def package(spark: SparkSession, lines: DataFrame, path: str) -> DataFrame:
    """Manifest ``query_id, rows, sha256`` of a submission; at most 100 short lines a query are gathered."""
    body = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]), "\n").alias("body"), F.count("*").alias("rows"))
    manifest = body.select("query_id", "rows", F.sha2("body", 256).alias("sha256"))
    manifest.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
