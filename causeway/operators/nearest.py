"""The most similar of many centres for each vector, by blocks of vectors against blocks of centres."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from causeway.session import ship

#: Bytes of centres that are sent to the tasks at once.
SENT = 128 << 20
ROWS = 1_024


def nearest(vectors: DataFrame, centres: DataFrame, k: int, id_col: str, vec_col: str, key_col: str, centre_col: str, kind_col: str | None = None, sent: int = SENT) -> DataFrame:
    """id, key, ``similarity`` (cosine to 9 digits) and ``rank`` of each vector's k most similar centres, ties by key; with ``kind_col``, a column of both, of those of its kind.

    Centres are taken in blocks of ``sent`` bytes at most, each with a pass over the vectors, in which a task multiplies a thousand vectors with the block
    and keeps k rows a vector; with one block nothing is shuffled. Vectors and centres without length, and nulls, have similarity 0.
    """
    ship(vectors.sparkSession)
    dims = centres.select(F.max(F.size(centre_col))).first()[0] or 1
    blocks = max(1, -(-centres.count() * dims * 8 // sent))
    kind = F.col(kind_col) if kind_col else F.lit(0)
    table = vectors.select(F.col(id_col).alias("id"), kind.alias("kind"), F.col(vec_col).cast("array<double>").alias("vec"))
    listed = centres.select(F.col(key_col).alias("key"), kind.alias("kind"), F.col(centre_col).cast("array<double>").alias("centre"))
    schema = StructType([StructField("id", vectors.schema[id_col].dataType), StructField("key", centres.schema[key_col].dataType), *StructType.fromDDL("similarity double, rank int")])

    def one(own: DataFrame) -> DataFrame:
        by_kind: dict = {}
        for r in own.toLocalIterator():  # SENT bytes at most
            by_kind.setdefault(r.kind, []).append((r.key, r.centre))
        held = {}
        for name, rows in by_kind.items():
            rows.sort(key=lambda r: r[0])
            held[name] = [x for x, _ in rows], _unit([x for _, x in rows], dims)

        def run(batches):
            for whole in batches:
                for at in range(0, len(whole), ROWS):
                    b = whole.slice(at, ROWS)
                    kinds, vecs, rows = b.column(1).to_pylist(), _unit(b.column(2).to_pylist(), dims), ([], [], [], [])
                    for name in dict.fromkeys(kinds):
                        if name not in held:
                            continue
                        keys, unit = held[name]
                        spots = np.array([i for i, x in enumerate(kinds) if x == name])
                        s = np.round(vecs[spots] @ unit.T, 9)
                        few = np.sort(np.argpartition(-s, min(k, len(keys)) - 1, axis=1)[:, :k], axis=1) if len(keys) > k else np.tile(np.arange(len(keys)), (len(spots), 1))
                        if len(keys) > k:  # equal ones at the edge: the first keys count
                            edge = np.take_along_axis(s, few, 1).min(1)
                            for i in np.flatnonzero((s >= edge[:, None]).sum(1) > k):
                                few[i] = np.sort(np.lexsort((np.arange(len(keys)), -s[i]))[:k])
                        top = np.take_along_axis(few, np.argsort(-np.take_along_axis(s, few, 1), axis=1, kind="stable"), 1)
                        for i, own_top in zip(spots, top, strict=True):
                            for rank, j in enumerate(own_top):
                                rows[0].append(i)
                                rows[1].append(keys[j])
                                rows[2].append(rank + 1)
                        rows[3].append(np.take_along_axis(s, top, 1).ravel())
                    values = np.concatenate(rows[3]) if rows[3] else np.zeros(0)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], key_type), pa.array(values), pa.array(rows[2], pa.int32())], names=["id", "key", "similarity", "rank"])

        from pyspark.sql.pandas.types import to_arrow_type

        key_type = to_arrow_type(centres.schema[key_col].dataType)
        return table.mapInArrow(run, schema)

    found = [one(listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i)) for i in range(blocks)]
    out = found[0]
    if blocks > 1:
        for x in found[1:]:
            out = out.unionByName(x)
        best = out.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "key"))), 1, k).alias("b"))  # k rows a block
        out = best.select("id", F.posexplode("b").alias("p", "x")).select("id", "x.key", (-F.col("x.d")).alias("similarity"), (F.col("p") + 1).alias("rank"))
    return out.select(F.col("id").alias(id_col), F.col("key").alias(key_col), "similarity", "rank")


def _unit(vectors: list, dims: int) -> np.ndarray:
    out = np.array([x if x is not None and len(x) == dims and None not in x else np.zeros(dims) for x in vectors], float).reshape(len(vectors), dims)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.nan_to_num(out / np.where(length > 0, length, 1.0))
