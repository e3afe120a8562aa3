"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}
#: As many as Spark takes by default.
MOST_BUCKETS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share; one of our own only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="causeway-")
        spark.sparkContext.setCheckpointDir(named)
        named = f"file://{named}" if "://" not in named else named
    return named.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/causeway-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._causeway_path = path
    return out


def materialize_by(df: DataFrame, column: str, values: list[str], name: str = "table") -> list[DataFrame]:
    """As :func:`materialize`, a table for each of the values that a text column takes; each is released on its own."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/causeway-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    rest = df.drop(column)
    out = []
    for value in values:
        part = f"{path}/{column}={value}"
        _scratch[part] = spark
        found = _exists(spark, part)
        table = spark.read.schema(rest.schema).parquet(part) if found else spark.createDataFrame([], rest.schema)
        table._causeway_path = part
        out.append(table)
    return out


def materialize_buckets(df: DataFrame, column: str, values: list[str], key: str, buckets: int, name: str = "table") -> list[DataFrame]:
    """As :func:`materialize_by`, with the rows of each table bucketed by ``key``: what groups or joins by it reads them where they lie, without a shuffle."""
    spark = df.sparkSession
    path, table = f"{scratch_dir(spark)}/causeway-{name}-{uuid.uuid4().hex}", f"causeway_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).partitionBy(column).bucketBy(min(buckets, MOST_BUCKETS), key).saveAsTable(table)
    _tables[table] = spark
    out = []
    for value in values:
        part = spark.table(table).filter(F.col(column) == value).drop(column)
        part._causeway_path = f"{path}/{column}={value}"
        _scratch[part._causeway_path] = spark
        out.append(part)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def release(df: DataFrame) -> None:
    """Delete the scratch table behind a DataFrame that :func:`materialize` returned."""
    path = getattr(df, "_causeway_path", None)
    if path and _scratch.pop(path, None) is not None:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of DataFrames that are gone: it learns of them by the driver's garbage collection, which may otherwise be hours away."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for table, spark in list(_tables.items()):
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session is gone, and its catalog with it  # noqa: BLE001
            pass
    for path, spark in list(_scratch.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder belongs to the cluster  # noqa: BLE001
            pass
