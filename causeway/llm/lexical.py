"""Ranked search over impact-ordered postings, score at a time.

A term's impact in a document is an integer; a term's postings are grouped by exact impact, and a query's
groups are processed in descending order of what they add to a score. Documents are dealt to shards; each
shard holds the groups of its own documents and stops a query once the groups that remain can't lift any
document that it hasn't met above the k-th best score so far. Scores of the documents that may still be
among the best are then completed, and the shards' best are ranked together.

Terms are maximal runs of characters other than ASCII punctuation, spaces and controls; only A-Z are
lower-cased. With N documents that have a term, L terms in all, n terms in a document, and df documents
that hold a term: weight = floor(1000 * ln((2N + 2) / (2df + 1))), m = 50 + (50 * n * N) div L, impact =
(1000000000 * tf) div (1000 * tf + 20 * m), score = sum of weight * impact over a query's terms, once each.

Queries are taken in blocks, each with a pass over the documents; what a block sends to tasks is the terms
of its queries. Shards have some 8,000 documents, so they grow in number with the table, not in size.

Defined results: a null or empty text has no terms, neither in documents nor as a query; such a query
returns nothing. Ties rank by ascending id, null ids last, repeated rows each with a rank of its own.
Texts of any length are read whole. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from causeway.llm.common import map_batches, materialize, release, texts
from causeway.session import ship

SHARD, BLOCK = 8_192, 10_000
#: Everything but letters, digits and bytes beyond ASCII becomes a space; A-Z become a-z.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def forward(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that has a term: ``doc``, ``n`` (all its terms) and ``found`` (array of term and tf) of the numbered ``terms``."""
    kind = docs.schema[id_col].dataType
    item = pa.struct([("term", pa.int32()), ("tf", pa.int64())])

    def run(batches):
        for b in batches:
            keep, n, ends, term, tf = [], [], [0], [], []
            for i, text in enumerate(texts(b.column(1))):
                own = terms_of(text)
                if not own:
                    continue
                keep.append(i)
                n.append(len(own))
                found = Counter(filter(terms.__contains__, own))
                term += map(terms.__getitem__, found)
                tf += found.values()
                ends.append(len(term))
            found = pa.StructArray.from_arrays([pa.array(term, pa.int32()), pa.array(tf, pa.int64())], fields=list(item))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["doc", "n", "found"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"doc {kind.simpleString()}, n bigint, found array<struct<term: int, tf: bigint>>")


def impact_index(documents: DataFrame, n_docs: int, n_terms: int, shard: int = SHARD) -> DataFrame:
    """Postings grouped by exact impact: shard, term, impact, and the rows of the documents that have it."""
    shards = max(1, -(-n_docs // shard))
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L").alias("m")
    each = documents.select("row", m, F.explode("found").alias("at")).select("row", F.col("at.term").alias("term"), F.expr("(1000000000L * at.tf) div (1000 * at.tf + 20 * m)").alias("impact"))
    return each.groupBy(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "term", "impact").agg(F.collect_list("row").alias("rows"))


class Shard:
    """Groups of one shard, a term's in descending order of impact, and each document's terms."""

    def __init__(self, term: np.ndarray, impact: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
        order = np.lexsort((-impact, term))
        starts = np.cumsum(sizes) - sizes
        take = np.repeat(starts[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(rows))
        self.rows, docs = np.unique(rows[take], return_inverse=True)
        self.docs, self.impact, self.ends = docs.astype(np.int64), impact[order], np.concatenate([[0], np.cumsum(sizes[order])])
        term = term[order]
        firsts = np.flatnonzero(np.diff(term, prepend=-1))
        self.span = {int(term[a]): (int(a), int(b)) for a, b in zip(firsts, [*firsts[1:], len(term)], strict=True)}
        # the same postings by document
        self.by_doc = np.argsort(self.docs, kind="stable")
        self.doc_ends = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=len(self.rows)))])
        self.post_term, self.post_impact = np.repeat(term, sizes[order]), np.repeat(self.impact, sizes[order])

    def best(self, query: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best with their whole scores, all of those above 0 if fewer; and how many postings were processed."""
        spans = [(self.span[t], w) for t, w in query.items() if w > 0 and t in self.span]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        group = np.concatenate([np.arange(a, b) for (a, b), _ in spans])
        adds = np.concatenate([w * self.impact[a:b] for (a, b), w in spans])
        of = np.repeat(np.arange(len(spans)), [b - a for (a, b), _ in spans])
        order = np.argsort(-adds, kind="stable")
        group, adds, of = group[order], adds[order], of[order]
        firsts, ends = np.array([x for x, _ in spans]).T
        weights, taken, done_groups = np.array([w for _, w in spans]), np.zeros(len(spans), np.int64), 0
        left = weights * self.impact[firsts]  # most that a term may still add to a document
        scores, at, done, step = np.zeros(len(self.rows), np.int64), 0, 0, max(64, len(group) // 32)
        while at < len(group):
            to = min(len(group), at + step)
            while to < len(group) and adds[to] == adds[to - 1]:
                to += 1
            sizes = self.ends[group[at:to] + 1] - self.ends[group[at:to]]
            spots = np.repeat(self.ends[group[at:to]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            scores += np.bincount(self.docs[spots], np.repeat(adds[at:to], sizes), len(scores)).astype(np.int64) if adds[at] * len(spots) < 1 << 52 else self._exact(spots, np.repeat(adds[at:to], sizes))
            done, at = done + len(spots), to
            taken += np.bincount(of[done_groups:at], minlength=len(spans))
            done_groups = at
            left = np.where(taken < ends - firsts, weights * self.impact[np.minimum(firsts + taken, len(self.impact) - 1)], 0)
            met = scores[scores > 0]
            if len(met) >= k and left.sum() < np.partition(met, len(met) - k)[len(met) - k]:
                break
        met = np.flatnonzero(scores)
        if len(met) > k:
            floor = np.partition(scores[met], len(met) - k)[len(met) - k]
            met = met[scores[met] + left.sum() >= floor]
        return met, self._complete(met, query), done

    def _exact(self, spots: np.ndarray, adds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.rows), np.int64)
        np.add.at(out, self.docs[spots], adds)
        return out

    def _complete(self, docs: np.ndarray, query: dict[int, int]) -> np.ndarray:
        sizes = self.doc_ends[docs + 1] - self.doc_ends[docs]
        ends = np.cumsum(sizes)
        spots = self.by_doc[np.repeat(self.doc_ends[docs] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        terms = np.array(sorted(query), np.int64)
        weights = np.array([query[t] for t in sorted(query)], np.int64)
        at = np.minimum(np.searchsorted(terms, self.post_term[spots]), len(terms) - 1)
        adds = np.where(terms[at] == self.post_term[spots], weights[at], 0) * self.post_impact[spots]
        return np.add.reduceat(adds, ends - sizes) if len(docs) else np.zeros(0, np.int64)


def shard_best(index: DataFrame, queries: list[dict[int, int]], k: int) -> DataFrame:
    """The k best documents of each shard for each query, those tied with the last one too: query (its place in the list), row, score."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.column("rows").combine_chunks()
        s = Shard(group.column("term").to_numpy(), group.column("impact").to_numpy(), np.diff(rows.offsets.to_numpy()), rows.flatten().to_numpy())
        out = []
        for q, query in enumerate(queries):
            docs, scores, _ = s.best(query, k)
            if len(docs) > k:
                docs, scores = docs[keep := scores >= np.partition(scores, len(scores) - k)[len(scores) - k]], scores[keep]
            out.append((np.full(len(docs), q, np.int32), s.rows[docs], scores))
        query, row, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": query, "row": row, "score": score.astype(np.int64)})

    ship(index.sparkSession)
    return index.groupBy("shard").applyInArrow(run, "query int, row bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item, ``rank``, id, ``score``."""
    spark = docs.sparkSession
    listed = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    blocks = max(1, -(-listed.count() // block))
    key: DataType = items.schema[item_col].dataType
    out = None
    for b in range(blocks):
        own = listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        asked = [(r.item, sorted(set(terms_of((r.text or "").encode())))) for r in own.toLocalIterator()]
        found = _search_block(docs, asked, k, id_col, text_col, shard)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(asked)], StructType([*_field("query int"), StructField("item", key)]))
        found = found.join(names, "query").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return out


def _field(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _search_block(docs: DataFrame, asked: list[tuple], k: int, id_col: str, text_col: str, shard: int) -> DataFrame:
    numbers = {t: i for i, t in enumerate(sorted({t for _, own in asked for t in own}))}
    documents = materialize(forward(docs, numbers, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "terms")
    total = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = dict(documents.select(F.explode("found.term").alias("term")).groupBy("term").count().collect())
    queries = [{numbers[t]: weight(total.n, df[numbers[t]]) for t in own if numbers[t] in df} for _, own in asked]
    best = shard_best(impact_index(documents, total.n, total.terms, shard), queries, k)
    top = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last(), "row")
    found = best.join(documents.select("row", "doc"), "row").withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    ranked = materialize(found.select("query", "rank", "doc", "score"), "ranked")  # k rows a query
    release(documents)
    return ranked
