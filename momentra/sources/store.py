"""Tables that outlive a plan: shared folders, whole-table replacement and corpus signatures."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one where that is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="momentra_")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def place(spark: SparkSession, name: str, *of: str) -> str:
    """A path that is the same for equal ``of`` in sessions that share a folder."""
    return f"{folder(spark)}/{name}-{hashlib.sha256('|'.join(of).encode()).hexdigest()[:16]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder: what several branches of a plan read is made once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def drop(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def publish(df: DataFrame, path: str) -> None:
    """Replaces the table at ``path``: readers see all of the old one or all of the new one.

    The rows are written under a name of their own; then one rename moves the pointer to it. A writer
    that fails leaves the pointer, and so the table, as it was.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    old = current(spark, path)
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = _fs(spark, path).create(_path(spark, f"{path}/{version}.pointer"), True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, path).getUri(), conf).rename(_path(spark, f"{path}/{version}.pointer"), _path(spark, f"{path}/CURRENT"), overwrite)
    if old:
        drop(spark, f"{path}/{old}")


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers get."""
    if not exists(spark, f"{path}/CURRENT"):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{current(spark, path)}")


def signature(df: DataFrame, *settings) -> str:
    """A digest of ``settings``, the row count and the order-free sum of row hashes of ``df``."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((settings, sorted(df.dtypes), n, str(total))).encode()).hexdigest()[:16]
