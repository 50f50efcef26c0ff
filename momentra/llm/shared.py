"""Shared-storage helpers: every intermediate table lives in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="momentra_")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Removes every table this process has written there; results that are still read go with them."""
    while _made:
        drop_path(spark, _made.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # small row groups: a writer holds one of them
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def some(df: DataFrame) -> bool:
    """Whether ``df`` has a row, by one job over all its partitions."""
    return df.agg(F.count("*")).first()[0] > 0


def tidied(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``build``, after which the tables that it has written and that its result does not read are gone."""

    @wraps(build)
    def run(*args, **options):
        before = set(_made)
        out = build(*args, **options)
        read = {part for f in out.inputFiles() for part in f.split("/")}
        for path in [p for p in _made if p not in before]:
            if path.rpartition("/")[2] not in read:
                drop_path(out.sparkSession, path)
                _made.remove(path)
        return out

    return run


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` gives as a written table; every other table that was written for it is gone."""
    before = set(_made)
    out = written(build(), name)
    for path in [p for p in _made[:-1] if p not in before]:
        drop_path(out.sparkSession, path)
        _made.remove(path)
    return out


def forget(table: DataFrame) -> None:
    """Removes a table that ``written`` gave and nothing reads any more."""
    read = {part for f in table.inputFiles() for part in f.split("/")}
    for path in [p for p in _made if p.rpartition("/")[2] in read]:
        drop_path(table.sparkSession, path)
        _made.remove(path)


def _located(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _located(spark, path)
    return fs.exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _located(spark, path)
    fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of plans that nothing refers to any more.

    The scheduler keeps its last plan until another one runs.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores in front until no column of ``df`` has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
