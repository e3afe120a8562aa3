"""Near-duplicate vectors by product quantisation, with an exact cosine rerank.

Equal vectors form a class. A coarse quantiser, the product of one for each half of the dimensions, deals the classes'
unit vectors into inverted lists, about as many as the square root of their number; of each vector's residual a product quantiser keeps one code for each subspace, and the exact length of
what the code misses. A vector searches its own list and those whose centroids are nearly as near; in
a list, table look-ups give the distance from the query to each code, and only vectors whose distance
less their miss is within reach are compared: that bound loses nothing. Cosines of candidates are then
computed in double precision, and links have at least ``threshold``.

Quantisers are fitted to a bounded sample (``sample`` classes, smallest hashes first); every vector is
indexed. Half a sample's worth of centroids in each half makes 10 ** 8 lists, so they may grow with the table. The probes decide recall: a pair
is found when either vector searches the other's list. Lists shrink as they grow in number and more of them lie within reach, so the probes
grow with the power ``SPREAD`` of the lists, at every size: that holds the recall of the worst case, random pairs at the threshold.

A list is cut into tiles of ``tile`` vectors and its queries into as many chunks, so no task holds more;
tasks return link counts and a spanning forest, never pairs.

Defined results: null or zero vectors and those with null or non-finite components link with nothing
and are their own component; so are vectors of another length than each other. Repeated rows are
linked. A cosine equal to the threshold links. ``kept`` is vec_id = component_id, false for a null id. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import map_batches, materialize
from causeway.llm.components import connected_components
from causeway.llm.simhash import _join

SAMPLE, TILE = 20_000, 2048
#: Lists that a vector searches: PROBES times the lists to the power SPREAD.
PROBES, SPREAD = 2.5, 0.3


def probes_for(lists: int) -> int:
    """10 of 101 lists, 28 of 3,000, 56 of 30,000."""
    return max(1, math.ceil(PROBES * lists**SPREAD))


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from k random rows; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Quantiser:
    """coarse: for each half of the dimensions, centroids; list i * len(coarse[1]) + j is that of the i-th and the j-th. books: subspaces by codes by their dimensions."""

    coarse: list[np.ndarray]
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, width: int = 4, codes: int = 256, seed: int = 9) -> Quantiser:
        half, k = x.shape[1] // 2, max(1, min(round(math.sqrt(lists)), len(x) // 2))
        coarse = [k_means(part, k, 8, seed + h) for h, part in enumerate((x[:, :half], x[:, half:]))] if half else [np.zeros((1, 0)), k_means(x, k, 8, seed)]
        q = cls(coarse, [], [])
        residual = x - q.centroids(q.probe(x, 1)[:, 0])
        cuts = [*range(0, x.shape[1], width), x.shape[1]]
        books = [k_means(residual[:, i:j], codes, 6, seed + 2 + i) for i, j in zip(cuts, cuts[1:], strict=False)]
        return cls(coarse, books, cuts)

    @property
    def width(self) -> int:
        return sum(c.shape[1] for c in self.coarse)

    def probe(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest ``probes`` lists of each row, nearest first, among the products of each half's nearest centroids."""
        half, near, far = self.coarse[0].shape[1], [], []
        for part, c in zip((x[:, :half], x[:, half:]), self.coarse, strict=True):
            d = squared(part, c)
            k = min(probes, d.shape[1])
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            near.append(at)
            far.append(np.take_along_axis(d, at, 1))
        total = (far[0][:, :, None] + far[1][:, None, :]).reshape(len(x), -1)
        names = (near[0][:, :, None] * len(self.coarse[1]) + near[1][:, None, :]).reshape(len(x), -1)
        order = np.argsort(total, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(names, order, 1)

    def centroids(self, lists: np.ndarray) -> np.ndarray:
        i, j = np.divmod(lists, len(self.coarse[1]))
        return np.concatenate([self.coarse[0][i], self.coarse[1][j]], axis=-1)

    def parts(self):
        return zip(self.cuts, self.cuts[1:], self.books, strict=False)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each vector lies from what its codes stand for."""
        residual = x - self.centroids(home)
        codes = np.stack([nearest(residual[:, i:j], b) for i, j, b in self.parts()], axis=1).astype(np.uint8)
        return codes, np.sqrt(((residual - self.decode(codes)) ** 2).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the vectors behind codes of one list, by table look-up."""
        residual, out = queries - self.centroids(np.int64(cell)), np.zeros((len(queries), len(codes)))
        for m, (i, j, b) in enumerate(self.parts()):
            out += squared(residual[:, i:j], b)[:, codes[:, m]]
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _assign(each: DataFrame, q: Quantiser, probes: int) -> DataFrame:
    """node, weight, vec, home, lists (searched, its own among them), codes, miss of each class."""

    kind = _kind(each)

    def run(batches):
        for b in batches:
            raw = _vectors(b.column(2))
            x = _unit(raw) if len(raw) else raw.reshape(0, q.width)
            lists = q.probe(x, probes)
            home = lists[:, 0]
            codes, miss = q.encode(x, home)
            binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), binary(raw.astype(kind)), pa.array(home), pa.array(lists.tolist(), pa.list_(pa.int64())), binary(codes), pa.array(miss)],
                names=["node", "weight", "vec", "home", "lists", "codes", "miss"],
            )

    return map_batches(each.select("node", "weight", "embedding"), run, "node bigint, weight bigint, vec binary, home bigint, lists array<bigint>, codes binary, miss double")


def _kind(each: DataFrame) -> str:
    """Vectors travel as they came: in single precision, if that is what the table has. Cosines are computed in double precision."""
    return "<f4" if each.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def _cell_links(q: Quantiser, threshold: float, kind: str):
    """applyInArrow over a cell: queries against the vectors of (a tile of) one list."""
    reach = math.sqrt(2 - 2 * threshold) + 1e-9

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("query").to_numpy()
        node, weight, home = (table.column(c).to_numpy() for c in ("node", "weight", "home"))
        cell = int(table.column("list")[0].as_py())
        vec = _unit(np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).astype(np.float64).reshape(-1, q.width))
        lists = table.column("lists").to_pylist()
        ours = np.flatnonzero(~query)
        codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(ours)).to_pylist()), np.uint8).reshape(len(ours), -1)
        limit = (reach + table.column("miss").to_numpy()[ours]) ** 2 + 1e-9
        counts, labels = np.zeros(len(node), np.int64), np.arange(len(node))
        searched = [frozenset(lists[y]) for y in ours]
        asking = np.flatnonzero(query)
        for at in range(0, len(asking), 128):
            some = asking[at : at + 128]
            i, j = np.nonzero(q.distances(vec[some], cell, codes) <= limit[None, :])
            x, y = some[i], ours[j]
            keep = (node[x] != node[y]) & (np.einsum("ij,ij->i", vec[x], vec[y]) >= threshold)
            x, y, j = x[keep], y[keep], j[keep]
            np.add.at(counts, x, weight[y])
            # y counts x itself where it searches x's list; else here
            lone = np.array([home[a] not in searched[b] for a, b in zip(x, j, strict=True)], bool)
            np.add.at(counts, y[lone], weight[x[lone]])
            if len(x):
                _join(labels, x, y)
        # a class may stand here as a query and as a vector of the list
        some = np.flatnonzero((counts > 0) | (labels != np.arange(len(node))))
        return pa.table({"node": node[some], "n": counts[some], "to": node[labels[some]]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, probes: int | None = None, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """id, n_links, component_id, kept of every vector. probes: by the number of lists (:func:`probes_for`), if None."""
    v, i = F.col(vec_col), F.col(id_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(i.alias("id"), v.alias("embedding"), F.coalesce(finite, F.lit(False)).alias("good"))
    each = rows.filter("good").groupBy("embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first"))
    each = materialize(each.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found, sizes = None, [(r.k, r.n) for r in each.groupBy(F.size("embedding").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()]
    for width, n in sorted(sizes):
        part = _links(each.filter(F.size("embedding") == width), n, threshold, probes, sample, tile)
        found = part if found is None else found.unionByName(part)
    bad = rows.filter("not good").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    if found is None:
        out = bad
    else:
        found = materialize(found, "links")
        degree = found.groupBy("node").agg(F.sum("n").alias("n"))
        comp = materialize(connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))), "components")
        comp = comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct())
        each = each.join(degree, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        each = materialize(each, "classes")
        least = each.groupBy("component").agg(F.min("first").alias("component_id"))
        each = each.join(least, "component").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
        out = rows.filter("good").join(each, "embedding").select("id", "n_links", "component_id").unionByName(bad)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(each: DataFrame, n: int, threshold: float, probes: int | None, sample: int, tile: int) -> DataFrame:
    """node, n (partial link counts), to (a node linked with it, or itself) of classes of one length."""
    h = F.pmod(F.xxhash64("embedding"), F.lit(1 << 32))
    drawn = each.filter(h < int((1 << 32) * min(1.0, 1.2 * sample / n))).orderBy(h).limit(sample).select("embedding").toPandas()
    x = _unit(np.array([np.asarray(e, np.float64) for e in drawn["embedding"]]))
    q = Quantiser.fit(x, max(1, round(math.sqrt(n))))
    indexed = materialize(_assign(each, q, probes or probes_for(math.prod(map(len, q.coarse)))), "indexed")
    # a row for each list: at most as many as the square root of the vectors, which the planner broadcasts if it is small
    size = indexed.groupBy(F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("own"))
    asked = indexed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    lookup = materialize(size.join(asked, "list").select("list", F.ceil(F.col("own") / tile).cast("int").alias("parts"), F.ceil(F.col("asked") / (4 * tile)).cast("int").alias("chunks")), "lists")
    h = F.xxhash64("node")
    deal = lambda df, own, other: (
        df.join(lookup, "list")
        .withColumn(own, F.pmod(h, F.col(f"{own}s")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s").cast("int") - 1)))
    )
    columns = ["list", "part", "chunk", "query", "node", "weight", "vec", "home", "lists", "codes", "miss"]
    ours = deal(indexed.withColumn("list", F.col("home")), "part", "chunk").withColumn("query", F.lit(False)).select(columns)
    asks = deal(indexed.withColumn("list", F.explode("lists")), "chunk", "part").withColumn("query", F.lit(True))
    asks = asks.withColumn("codes", F.lit(None).cast("binary")).withColumn("lists", F.lit(None).cast("array<bigint>")).withColumn("miss", F.lit(0.0)).select(columns)
    return ours.unionByName(asks).groupBy("list", "part", "chunk").applyInArrow(_cell_links(q, threshold, _kind(each)), "node bigint, n bigint, to bigint")
