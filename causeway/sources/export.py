"""Manifests of exports: one digest of any number of rows, as a tree of hashes over ranges of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN, LEVELS = 1_000, 4


def digests(rows: DataFrame, keys: list[str], id_col: str, content: Column, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """keys, ``n`` and ``digest`` of each key's rows in the order of their ids, which are unique and not negative.

    A row's hash is a leaf. On each level the hashes of up to ``fan`` neighbours, by ranges of ids, are hashed in order, and ranges of ranges above; the last
    level takes what is left of a key, one range for ``fan ** (levels - 1)`` ids. So no group holds more than ``fan`` hashes below the last level.
    """
    level = rows.select(*keys, F.col(id_col).cast("bigint").alias("at"), F.sha2(content, 256).alias("h"), F.lit(1).cast("bigint").alias("n"))
    for depth in range(levels):
        up = F.floor(F.col("at") / fan) if depth + 1 < levels else F.lit(0)
        hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        level = level.groupBy(*keys, up.alias("up")).agg(F.sha2(hashes, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "at")
    return level.select(*keys, "n", F.col("h").alias("digest"))
