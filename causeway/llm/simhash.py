"""Near-duplicate texts: SimHash fingerprints joined exactly by vantage-point trees.

There is a tree for each half of the bits, as fingerprints that differ in ``radius`` bits differ in half as many at most in one half. A tree's levels each measure the Hamming
distance to a vantage point within a block of four bits of that half; a fingerprint's home is the
shell at its distance on every level. Blocks don't share bits, so the triangle inequality bounds the sum
over all levels: |d(v, x) - d(v, y)|, summed, is at most d(x, y). A branch is pruned as soon as the sum of
these differences exceeds the reach, which leaves few of them (in one space of 64 bits, where distances to a vantage
point lie within 32 +- 4, each level alone would keep more than half).

The upper levels, as many as the number of fingerprints asks for, make the shards. Each fingerprint lies
in its home shard and is sent as a query to those shards whose shells overlap its reach; of two shards only
the one with smaller distances asks the other. Inside a shard the lower levels prune on, then the distance over all
bits decides. A shard of more than ``16 * shard`` fingerprints is cut into tiles and its queries
into chunks. Only a spanning forest of the links leaves a task: rows grow with the fingerprints, not with the pairs.

Costs: with L levels of shards a fingerprint is sent to L ** 2 + L + 1 shards of each tree at most. Of 10 ** 5 random fingerprints' pairs 8.5 % are compared,
of 2.35 * 10 ** 5 3.7 %; work grows with about the power 1.5 of the number of distinct fingerprints.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other. Texts are read whole, however long. Repeated
rows have the same fingerprint and component. ``component_id`` is the smallest id that isn't null, null
where a component has none; ties of :func:`deduplicate` go to the first row of the smallest id. An empty table gives an empty result. Further columns are ignored by
:func:`near_duplicates` and passed through by :func:`deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from causeway.llm.common import LOWER, map_batches, materialize, texts
from causeway.llm.components import connected_components

SHINGLE, SEED, RADIUS, SHARD = 4, 42, 4, 2048


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit by bit the majority of the shingles' XXH64, as an unsigned integer."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(whole, seed)  # one shingle: every bit set in it is set in over half
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]])
    hashes = [digest(whole[i:j], seed) for i, j in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """All columns and the fingerprint as a signed bigint."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(x) for x in texts(b.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, name])

    return map_batches(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))


# --- inside a shard ---


def _join(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merges the classes of u[i] and v[i]; each class is labelled by its smallest member."""
    while True:
        x, y = labels[u], labels[v]
        open_ = x != y
        if not open_.any():
            return
        x, y = x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(flat := labels[labels], labels):
            labels[:] = flat


#: Vantage points of all levels, as one fingerprint; any will do, as fingerprints spread evenly.
VANTAGE = np.uint64(0x9E3779B97F4A7C15)
WIDTH, LEVELS, HALVES = 4, 8, 2
#: Pairs that are compared at once; smaller branches aren't cut further.
BLOCK = 1 << 18


def level_mask(tree: int, level: int) -> np.uint64:
    """The block of bits on which a level measures."""
    return np.uint64((1 << WIDTH) - 1 << WIDTH * (tree * LEVELS + level))


def shells(fps: np.ndarray, tree: int, levels: range) -> np.ndarray:
    """Distances of fingerprints to the vantage point on each level."""
    far = fps ^ VANTAGE
    return np.stack([np.bitwise_count(far & level_mask(tree, k)).astype(np.int64) for k in levels], axis=1)


def shard_levels(n: int, shard: int) -> int:
    """Levels that make shards of about ``shard`` fingerprints; a level of four bits tells 2.03 bits' worth."""
    return int(np.clip(np.ceil(np.log2(max(n / shard, 1)) / 2.03), 1, LEVELS))


def offsets(levels: int, reach: int) -> list[tuple[int, ...]]:
    """Differences of shells, summing up to ``reach`` at most, whose first one is positive; and none at all, the home."""
    out = [()]
    for _ in range(levels):
        out = [(*x, k) for x in out for k in range(-reach, reach + 1) if sum(map(abs, x)) + abs(k) <= reach]
    return [x for x in out if next((k for k in x if k), 1) > 0]


def route(fps: np.ndarray, levels: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cell, fingerprint, and how far its shells are from the cell's (0: its home), for all cells of both trees within reach."""
    cells, who, used = [], [], []
    place = 3 * np.arange(levels)
    for tree in range(HALVES):
        d = shells(fps, tree, range(levels))
        for x in offsets(levels, reach):
            at = d + np.array(x)
            some = np.flatnonzero(((at >= 0) & (at <= WIDTH)).all(1))
            cells.append((at[some] << place).sum(1) | tree << 3 * LEVELS)
            who.append(fps[some])
            used.append(np.full(len(some), sum(map(abs, x)), np.int8))
    return np.concatenate(cells), np.concatenate(who), np.concatenate(used)


class Search:
    """Links between a shard's fingerprints and queries; ``labels`` are the classes of linked ones, ``compared`` counts pairs that no bound pruned."""

    def __init__(self, home: np.ndarray, queries: np.ndarray, used: np.ndarray, tree: int, levels: int, radius: int, among: bool = True):
        self.nodes, at = np.unique(np.concatenate([home, queries]), return_inverse=True)
        self.labels, self.compared = np.arange(len(self.nodes)), 0
        self.radius, self.reach, self.tree = radius, radius // HALVES, tree
        own, asking = at[: len(home)], at[len(home) :]
        if among:
            self.branch(own, own, np.zeros(len(own), np.int64), levels)
        self.branch(own, asking, used.astype(np.int64), levels)

    def branch(self, a: np.ndarray, b: np.ndarray, used: np.ndarray, level: int) -> None:
        """All links of a and b; ``used``: of each of b, the differences of the levels above."""
        if not len(a) or not len(b):
            return
        if level == LEVELS or len(a) * len(b) <= BLOCK:
            return self.compare(a, b)
        da, db = (shells(self.nodes[x], self.tree, range(level, level + 1))[:, 0] for x in (a, b))
        for shell in np.unique(da):
            total = used + np.abs(db - shell)
            near = total <= self.reach
            self.branch(a[da == shell], b[near], total[near], level + 1)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        self.compared += len(a) * len(b)
        step = max(1, 4 * BLOCK // len(b))
        for k in range(0, len(a), step):
            part = a[k : k + step]
            i, j = np.nonzero(np.bitwise_count(self.nodes[part][:, None] ^ self.nodes[b][None, :]) <= self.radius)
            if len(i):
                _join(self.labels, part[i], b[j])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.labels != np.arange(len(self.labels)))
        return self.nodes[moved], self.nodes[self.labels[moved]]


HOME, TILE, QUERY = 0, 1, 2  # roles: TILE is a home row whose like are compared in another chunk


def _shard_links(radius: int, levels: int):
    """mapInArrow over (key, cell, fp, used, role) sorted by key: links of a spanning forest of each key."""

    def groups(batches):
        held: list[np.ndarray] = []
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            cuts = np.flatnonzero(np.diff(held[0])) + 1
            if len(cuts):  # the last key may go on in the next batch
                edges = [0, *cuts.tolist()]
                for i, j in zip(edges, edges[1:], strict=False):
                    yield [x[i:j] for x in held]
                held = [x[edges[-1] :] for x in held]
        if held and len(held[0]):
            yield held

    def run(batches):
        a, b, n = [], [], 0
        for _, cell, fp, used, role in groups(batches):
            home = role != QUERY
            if not home.any():
                continue
            fp = fp.view(np.uint64)
            found = Search(fp[home], fp[~home], used[~home], int(cell[0]) >> 3 * LEVELS, levels, radius, bool((role == HOME).any())).forest()
            if len(found[0]):
                a.append(found[0].view(np.int64))
                b.append(found[1].view(np.int64))
                n += len(found[0])
            if n > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, n = [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


# --- across shards ---


def links(fps: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """fps: distinct bigints ``fp``, ``n`` of them. Edges ``a``, ``b`` whose components are those of all links."""
    levels, reach = shard_levels(n, shard), radius // HALVES

    def send(batches):
        for b in batches:
            for at in range(0, len(b), 4096):
                cell, fp, used = route(b.column(0).slice(at, 4096).to_numpy().view(np.uint64), levels, reach)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp.view(np.int64)), pa.array(used)], names=["cell", "fp", "used"])

    sent = map_batches(fps.select("fp"), send, "cell bigint, fp bigint, used tinyint")
    homes = map_batches(fps.select("fp"), _homes(levels), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    large = materialize(homes.filter(F.col("n") > 16 * shard).select("cell", F.ceil(F.col("n") / (16 * shard)).cast("int").alias("tiles")), "shards")
    role = F.when(F.col("used") == 0, HOME).otherwise(QUERY).cast("tinyint")
    columns = ["key", "cell", "fp", "used", "role"]
    if large.limit(1).count():
        small = sent.join(large.select("cell"), "cell", "left_anti").withColumn("key", F.col("cell")).withColumn("role", role).select(columns)
        sent = small.unionByName(_tiles(sent.join(large, "cell")).select(columns))
    else:
        sent = sent.withColumn("key", F.col("cell")).withColumn("role", role).select(columns)
    dealt = sent.repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, _shard_links(radius, levels), "a bigint, b bigint").distinct()


def _homes(levels: int):
    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            at = [(shells(fps, tree, range(levels)) << 3 * np.arange(levels)).sum(1) | tree << 3 * LEVELS for tree in range(HALVES)]
            cell, n = np.unique(np.concatenate(at), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return run


def _tiles(sent: DataFrame) -> DataFrame:
    """Rows of large shards by (tile, chunk): a home row lies in every chunk of its tile, a query in its chunk of every tile; home rows ask the later tiles."""
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    all_ = F.sequence(F.lit(0), F.col("tiles") - 1)
    out = sent.withColumn("own", tile)
    at_home = out.filter("used = 0").select("*", F.col("own").alias("tile"), F.explode(all_).alias("chunk")).withColumn("role", F.when(F.col("chunk") == 0, HOME).otherwise(TILE))
    later = out.filter("used = 0 and own < tiles - 1").select("*", F.explode(F.sequence(F.col("own") + 1, F.col("tiles") - 1)).alias("tile"), F.col("own").alias("chunk")).withColumn("role", F.lit(QUERY))
    asking = out.filter("used > 0").select("*", F.explode(all_).alias("tile"), F.col("own").alias("chunk")).withColumn("role", F.lit(QUERY))
    both = at_home.unionByName(later).unionByName(asking)
    return both.withColumn("key", F.xxhash64("cell", "tile", "chunk")).withColumn("role", F.col("role").cast("tinyint"))


def classes(marked: DataFrame, first: Column, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """marked: a column ``fp`` and what ``first``, an aggregate, needs. Returns fp and ``first`` of its component."""
    each = materialize(marked.groupBy("fp").agg(first.alias("first")), "fingerprints")
    found = materialize(connected_components(links(each.select("fp"), each.count(), radius, shard)), "components")
    found = found.select(F.col("node").alias("fp"), F.col("component"))
    found = found.unionByName(found.select(F.col("component").alias("fp"), F.col("component")).distinct())
    linked = materialize(each.join(found, "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select("fp", "least")
    return each.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, ``fingerprint`` (hexadecimal) and ``component_id`` of every document."""
    marked = materialize(fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col).select(F.col(id_col), "fp"), "marked")
    found = classes(marked, F.min(id_col), radius)
    return marked.join(found, "fp", "left").select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id, nulls last."""
    rid, fp = "_sim_rid", "_sim_fp"
    while rid in docs.columns or fp in docs.columns:
        rid, fp = rid + "_", fp + "_"
    numbered = materialize(fingerprints(docs, text_col, fp).withColumn(rid, F.monotonically_increasing_id()), "numbered")
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"), F.col(rid).alias("rid"))
    marked = numbered.select(F.col(fp).alias("fp"), order.alias("row"))
    kept = classes(marked, F.min("row"), radius).select(F.col("first.rid").alias(rid)).distinct()
    return numbered.join(kept, rid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
