"""As-of joins: each row gets the last mark at or before its time, by one sort of both on the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str]) -> DataFrame:
    """rows and marks: keys, ``at``. Adds the columns ``carry`` of the last mark of the same key at or before each row's time, null if there is none.

    Both are laid in one sequence and the last mark is carried along it: no row meets more than one, whatever the number of marks.
    """
    own = [c for c in rows.columns if c not in (*keys, at)]
    lay = lambda df, is_row, row, mark: df.select(*keys, F.col(at), F.lit(is_row).alias("_row"), row.alias("_own"), mark.alias("_mark"))
    of_row, of_mark = F.struct(*own), F.struct(*carry)
    kind_row, kind_mark = rows.select(of_row.alias("x")).schema["x"].dataType, marks.select(of_mark.alias("x")).schema["x"].dataType
    both = lay(marks, 0, F.lit(None).cast(kind_row), of_mark).unionByName(lay(rows, 1, of_row, F.lit(None).cast(kind_mark)))
    w = Window.partitionBy(*keys).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_mark", F.last("_mark", ignorenulls=True).over(w)).filter("_row = 1").select(*keys, at, "_own.*", *[F.col(f"_mark.{c}").alias(c) for c in carry])
