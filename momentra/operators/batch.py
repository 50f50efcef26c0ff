"""Running a pack of queries: what is left to do, in which order, and how thoroughly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import governed
from ..functions.text import infer_task


def plan(files: DataFrame, finished: DataFrame, minutes_left: Column, full_minutes: float = 5.0) -> DataFrame:
    """``name, task, pos, sprint``: unfinished files by task, then name; ``sprint`` once time runs out.

    A finished file counts only with rows and without issues; each later file has the minutes that
    the ones before it leave.
    """
    done = finished.where("n_rows > 0 and n_issues = 0").select("name")
    task = infer_task(F.col("name"))
    left = files.join(done, "name", "left_anti").withColumn("task", task)
    order = F.when(F.col("task").isin("kis", "avs"), 0).when(F.col("task") == "trake", 1).otherwise(2)
    told = left.withColumn("pos", F.row_number().over(Window.partitionBy().orderBy(order, "name")))  # one pack
    return told.select("name", "task", "pos", (governed(minutes_left) < F.col("pos") * full_minutes).alias("sprint"))
