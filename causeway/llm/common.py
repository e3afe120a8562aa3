"""What the operators of this subpackage share: words, held-out folds, scratch tables.

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; ``bytes.split()``
splits on exactly these, whereas ``str.split()`` also splits on other Unicode spaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causeway.scratch import materialize, materialize_buckets, materialize_by, release, scratch_dir, sweep  # noqa: F401
from causeway.session import ship

WHITE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(folds)


def held_out(doc_id: str | Column, folds: int) -> Column:
    """True where the fold is 1; false for null ids."""
    return F.coalesce(fold(doc_id, folds) == 1, F.lit(False))


def learnable(doc_id: str | Column, folds: int) -> Column:
    """True where a model may learn from the row; false for null ids, whose fold is unknown."""
    return F.coalesce(fold(doc_id, folds) != 1, F.lit(False))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
