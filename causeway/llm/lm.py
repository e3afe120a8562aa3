"""Language model scores from a hierarchical Pitman-Yor model.

Tokens are words and one end for each text. Every context, the word before (the end, at the beginning),
has a restaurant, known by the word's code; all share the unigram restaurant as parent, whose base
is uniform over the vocabulary and one unknown word. Seating is sampled by Gibbs: in turn each dish's number of
tables in a context is drawn given all others, from its conditional probability under the Chinese
restaurant process (generalised Stirling numbers times the parent's predictive probability), then the
tables of the dish in the parent. After ``burn`` sweeps, table counts are averaged over ``sweeps``
samples; as the predictive probability is linear in them, the averaged probability is
    P(w | u) = (c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u)
and sums to one over the vocabulary. Discounts come from the counts of ones and twos.

The model is as large as the corpus makes it, in shards of words by hash; workers sample one shard's
dishes at a time. A context's tables lie in the shards of the words that follow it; they are summed in the
shard of the context's own word, before seating and after it (:func:`restaurants`). Its customers are as
many as the word's own, as each word but the end is followed by one token, and each end by a text. Texts are
cut into chunks of about ``chunk`` bytes; a chunk sends each shard its distinct words with their
contexts and counts, and gets back what their probabilities are made of. No vocabulary is broadcast or held whole.

Words are coded for the wire: the commonest of a bounded sample (``CODES`` at most, 2 MB) by their rank, all others by 48 bits of their
hash. The table only shortens what is sent; any other gives the same contexts.

Defined results: a null or empty text has the end alone. Rows with a null id are scored, but not
learned from. With nothing to learn from, all tokens are unknown. Texts are scored whole, however long. Repeated rows count,
and are scored, each on its own. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import LOWER, map_batches, materialize, materialize_by, release, sweep, texts

CHUNK, SHARD, END = 8_000_000, 12_000_000, b" "  # no word holds a space
SHIFT = 32  # a chunk's word numbers fit 30 bits
MERGE = 4_000_000  # pairs of a shard that may wait to be merged
SEEN = np.dtype([("u", "<u8"), ("n", "<f8"), ("t", "<f4")])
CODES, SAMPLE = 1 << 18, 32_000_000  # words with a rank; bytes of text that they are found in
BITS = 48


def planes(x: np.ndarray) -> bytes:
    """Numbers as one string of all first bytes, one of all second bytes, and so on."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(codes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Codes as marks of those that are hashes, the ranks, and the hashes' 48 bits."""
    hashed = codes >> np.uint64(BITS) != 0
    rest = np.ascontiguousarray(codes[hashed].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8])
    return np.packbits(hashed).tobytes(), planes(codes[~hashed].astype("<u4")), rest.tobytes()


def unpack(marks: bytes, ranks: bytes, rest: bytes) -> np.ndarray:
    few, many = unplanes(ranks, "<u4"), np.frombuffer(rest, np.uint8).reshape(-1, BITS // 8)
    hashed = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(few) + len(many)).astype(bool)
    out = np.empty(len(hashed), np.uint64)
    out[~hashed] = few
    wide = np.zeros((len(many), 8), np.uint8)
    wide[:, : BITS // 8] = many
    wide[:, BITS // 8] = 1
    out[hashed] = wide.view("<u8").ravel()
    return out


class Codebook:
    """Codes of words by their 64-bit hashes."""

    def __init__(self, hashes: np.ndarray):
        """hashes: of the commonest words, in order of rank."""
        self.rank = np.argsort(hashes, kind="stable").astype(np.uint64)
        self.hashes = hashes[self.rank.astype(np.int64)]

    def code(self, h: np.ndarray) -> np.ndarray:
        out = h & np.uint64((1 << BITS) - 1) | np.uint64(1 << BITS)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.rank[at[hit]]
        return out

    def codes(self, words: list[bytes]) -> np.ndarray:
        return self.code(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def codebook(rows: DataFrame, size: int, most: int = CODES, sample: int = SAMPLE) -> Codebook:
    """rows: id, learn, text of ``size`` bytes. Hashes of up to ``most`` words reach the driver."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in texts(b.column(0)):
                seen.update(text.translate(LOWER).split())
                seen[END] += 1
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(seen.values()), pa.int64())], names=["h", "n"])

    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 31)) < int((1 << 31) * min(1.0, sample / max(size, 1)))).select("text")
    counts = map_batches(drawn, count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    got = counts.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow().column(0)
    return Codebook(np.array(got.to_pylist(), np.int64).view(np.uint64))


LEVEL = 9


def freeze(*parts: bytes) -> bytes:
    """Byte strings as one blob, each compressed on its own, as they have little in common."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
    small = [squeeze(x) for x in parts]
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, small)) + b"".join(small)


def thaw(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", blob)[0]
    expand, out, at = zstandard.ZstdDecompressor().decompress, [], 4 * (n + 1)
    for k in struct.unpack_from(f"<{n}I", blob, 4):
        out.append(expand(blob[at : at + k]))
        at += k
    return out


# --- counting ---


class Chunk:
    """Texts in local word numbers, ordered by shard, with the counts of (word, context)."""

    def __init__(self, shards: int, book: Codebook):
        self.book = book
        self.shards, self.words, self.tokens, self.docs, self.size = shards, {}, [], [], 0

    def add(self, doc, learn: bool, text: bytes) -> None:
        words = text.translate(LOWER).split()
        words.append(END)
        known = self.words
        for w in set(words).difference(known):
            known[w] = len(known)
        self.tokens.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.docs.append((doc, learn, len(words)))
        self.size += len(text) + 8

    def rows(self, number: int, kind: pa.DataType):
        """Document rows, the first with the chunk's tokens, then a row for each shard of its words."""
        vocabulary = list(self.words)
        h = self.book.codes(vocabulary)
        shard = shard_of(h, self.shards)
        order = np.array(sorted(range(len(vocabulary)), key=vocabulary.__getitem__), np.int64)  # in order they compress better
        order = order[np.argsort(shard[order], kind="stable")]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        tokens, lengths = place[np.concatenate(self.tokens)], np.array([n for _, _, n in self.docs])
        keys = (tokens.astype(np.int64) << SHIFT | contexts(tokens, lengths)) << 1
        keys |= np.repeat(np.array([x for _, x, _ in self.docs], np.int64), lengths)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys >> 1) > 0]))
        learned = np.add.reduceat(keys & 1, first)
        asked = keys[first] >> 1
        of = asked >> SHIFT
        data = freeze(planes(tokens))
        h = h[order]
        k = len(self.docs)
        nothing = lambda m, t: pa.nulls(m, t)
        ids, learn = pa.array([x for x, _, _ in self.docs], kind), pa.array([x for _, x, _ in self.docs], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, number)), ids, learn, pa.array(lengths, pa.int64()), nothing(k, pa.int64()), pa.array([data] + [None] * (k - 1), pa.binary())], names=ROW
        )
        cuts = np.searchsorted(shard[order], np.unique(shard)).tolist() + [len(order)]
        ends = np.searchsorted(of, cuts).tolist()
        blobs = []
        for i, j, p, q in zip(cuts, cuts[1:], ends, ends[1:], strict=False):
            names = [vocabulary[x] for x in order[i:j]]
            sizes = np.bincount(of[p:q] - i, minlength=j - i)
            blobs.append(freeze(_lengths(names), b"".join(names), planes(sizes.astype("<u4")), planes(learned[p:q].astype("<u4")), *pack(h[asked[p:q] & (1 << SHIFT) - 1])))
        m = len(blobs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, number)), nothing(m, kind), pa.array([self.docs[0][1]] * m), nothing(m, pa.int64()), pa.array(np.unique(shard).astype(np.int64)), pa.array(blobs, pa.binary())], names=ROW
        )


ROW = ["chunk", "id", "learn", "n", "shard", "data"]


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)


def contexts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The context of each token: the number of the one before, the end's at the beginning of a text."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = tokens[-1]  # each text ends with the end
    return before


def _lengths(words: list[bytes]) -> bytes:
    return planes(np.fromiter(map(len, words), "<u4", len(words)))


def _names(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(unplanes(lengths, "<u4").astype(np.int64)).tolist()
    return [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _chunks(docs: DataFrame, chunk: int, shards: int, book: Codebook) -> DataFrame:
    """docs: id, learn, text. Rows of :class:`Chunk`."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        number, arrow = TaskContext.get().partitionId() << 20, None
        now = {x: Chunk(shards, book) for x in (True, False)}  # texts to learn from and others apart, so that only the former's words are sent to learn
        for b in batches:
            arrow = b.schema.field(0).type
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                for doc, learn, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), strict=True):
                    now[bool(learn)].add(doc, bool(learn), text)
                    if now[bool(learn)].size >= chunk:
                        yield from now[bool(learn)].rows(number, arrow)
                        number, now[bool(learn)] = number + 1, Chunk(shards, book)
        for last in now.values():
            if last.docs:
                yield from last.rows(number, arrow)
                number += 1

    return map_batches(docs, run, f"chunk bigint, id {kind}, learn boolean, n bigint, shard bigint, data binary")


class Shard:
    """Words of one shard with their learned (context, count) pairs, gathered from the chunks."""

    def __init__(self):
        self.words, self.parts, self.waiting = {}, [], 0

    def add(self, blob: bytes) -> None:
        lengths, names, sizes, n, *u = thaw(blob)
        known, names = self.words, _names(lengths, names)
        for w in names:
            if w not in known:
                known[w] = len(known)
        of = np.repeat(np.fromiter(map(known.__getitem__, names), np.int64, len(names)), unplanes(sizes, "<u4"))
        n = unplanes(n, "<u4")
        some = n > 0
        self.parts.append((of[some], unpack(*u)[some], n[some].astype(np.float64)))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > MERGE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, contexts and counts of the distinct pairs, sorted."""
        of, u, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((u, of))
        of, u = of[order], u[order]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (u[1:] != u[:-1])])[: len(of)])
        merged = of[first], u[first], np.add.reduceat(n[order], first) if len(first) else n
        self.parts, self.waiting = [merged], 0
        return merged

    def table(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Learned words, sorted pairs' word numbers and SEEN rows with one table each."""
        of, u, n = self.merge()
        pairs = np.zeros(len(of), SEEN)
        pairs["u"], pairs["n"], pairs["t"] = u, n, 1
        learned, of = np.unique(of, return_inverse=True)
        every = list(self.words)
        return [every[i] for i in learned], of, pairs


def _by_shard(batches):
    """Rows of (shard, number, data), sorted, as they come: shard, number, data."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)


FITTED = "shard bigint, data binary, sums array<double>"


def _fitted_batch(shard: int, words: list[bytes], of: np.ndarray, pairs: np.ndarray, k: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    """A shard's words and seating, and its sums: customers, tables, ones and twos, then words, parent customers and roots."""
    sums = [x.sum() for x in (pairs["n"], pairs["t"].astype(np.float64), pairs["n"] == 1, pairs["n"] == 2)]
    sizes = np.bincount(of, minlength=len(words)).astype("<u4")
    data = freeze(_lengths(words), b"".join(words), planes(sizes), planes(pairs["n"].astype("<u4")), planes(pairs["t"].copy()), planes(k.astype("<f8")), planes(r.astype("<f8")), *pack(pairs["u"]))
    flat = [*map(float, sums), float(len(words)), float(k.sum()), float(r.sum())]
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([data], pa.binary()), pa.array([flat], pa.list_(pa.float64()))], names=["shard", "data", "sums"])


def _merge(batches):
    """mapInArrow over (shard, chunk, data) sorted by shard: each shard's learned words."""
    now, shard = None, None
    for at, _, data in _by_shard(batches):
        if at != shard:
            if now:
                yield _merged(shard, now)
            now, shard = Shard(), at
        now.add(data)
    if now:
        yield _merged(shard, now)


def _merged(shard: int, now: Shard) -> pa.RecordBatch:
    words, of, pairs = now.table()
    ones = np.ones(len(words))
    return _fitted_batch(shard, words, of, pairs, np.bincount(of, minlength=len(words)).astype(float), ones)


def _thawed(data: bytes):
    """Words, pairs' word numbers, pairs, parent customers, roots."""
    lengths, names, sizes, n, t, k, r, *u = thaw(data)
    sizes = unplanes(sizes, "<u4")
    pairs = np.zeros(len(n) // 4, SEEN)
    pairs["u"], pairs["n"], pairs["t"] = unpack(*u), unplanes(n, "<u4"), unplanes(t, "<f4")
    return _names(lengths, names), np.repeat(np.arange(len(sizes)), sizes), pairs, unplanes(k, "<f8"), unplanes(r, "<f8")


# --- restaurants ---

SENT = "shard bigint, number bigint, data binary"


def _sent(shards: list[int], numbers: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "number", "data"])


def _dealt(table: DataFrame, shards: int) -> DataFrame:
    """Rows by shard, a partition for each, so that tasks stay of one size as the table grows."""
    return table.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "number")


def _of_contexts(u: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, by shard and hash; the place of each u among them; their shards."""
    distinct, at = np.unique(u, return_inverse=True)
    own = shard_of(distinct, shards).astype(np.int64)
    order = np.argsort(own, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[at], own[order]


def restaurants(table: DataFrame, shards: int, reply: bool) -> DataFrame:
    """Tables of each context over all shards, at the shard of its word (number -1: hashes, tables); ``reply``: sent back to the shards that asked (number: who replies)."""

    def send(batches):
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, _, pairs, _, _ = _thawed(data)
                u, at, own = _of_contexts(pairs["u"], shards)
                t = np.bincount(at, pairs["t"], len(u)).astype("<f4")
                to = np.unique(own)
                cuts = [*np.searchsorted(own, to).tolist(), len(own)]
                yield _sent(to.tolist(), [shard] * len(to), [freeze(planes(t[i:j]), *pack(u[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)])

    def total(shard, froms, parts):
        u, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        distinct, at = np.unique(u, return_inverse=True)
        sums = np.bincount(at, t, len(distinct))
        if not reply:
            return _sent([shard], [-1], [freeze(planes(sums.astype("<f8")), *pack(distinct))])
        ends = np.cumsum([len(p[0]) for p in parts]).tolist()
        return _sent(froms, [shard] * len(froms), [freeze(planes(sums[at[i:j]].astype("<f4"))) for i, j in zip([0, *ends], ends, strict=False)])

    def add(batches):
        shard, froms, parts = None, [], []
        for at, of, data in _by_shard(batches):
            if at != shard:
                if parts:
                    yield total(shard, froms, parts)
                shard, froms, parts = at, [], []
            froms.append(of)
            t, *u = thaw(data)
            parts.append((unpack(*u), unplanes(t, "<f4").astype(float)))
        if parts:
            yield total(shard, froms, parts)

    return map_batches(_dealt(map_batches(table.select("shard", "data"), send, SENT), shards), add, SENT)


# --- seating ---


@dataclass(frozen=True)
class Totals:
    """Of the parent: customers and tables; the vocabulary; discounts and strength."""

    parent: float
    roots: float
    words: int
    tokens: int
    discount: float
    root_discount: float
    strength: float = 1.0

    def parent_of(self, k: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Predictive probability of a dish with k customers at r tables in the parent."""
        base = (self.strength + self.root_discount * self.roots) / (self.words + 1)
        return (k - self.root_discount * r + base) / (self.strength + self.parent)

    def predictive(self, own: np.ndarray, parent: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of words in contexts: own, c_uw - d t_uw; the parent's P(w); customers and tables of the context."""
        return (own + (self.strength + self.discount * tables) * parent) / (self.strength + customers)


MOST = 64


@lru_cache(maxsize=8)
def stirling(discount: float, most: int = MOST) -> np.ndarray:
    """log of the generalised Stirling numbers S(n, t), from S(n + 1, t) = S(n, t - 1) + (n - d t) S(n, t)."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0
    for n in range(most):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            s[n + 1, 1 : n + 2] = np.logaddexp(s[n, :-1][: n + 1], np.log(np.maximum(n - discount * t, 0)) + s[n, 1 : n + 2])
    return s


def seat(n: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Draws the tables of n customers of one dish; ``weight``: that of a new table, (s + d t_u) P(w).

    Up to MOST customers exactly, from S(n, t) weight ** t; the others are seated on top of a draw for
    MOST, in rounds that double their number, new tables by binomial draws.
    """
    t, table, few = np.ones(len(n)), stirling(discount), np.minimum(n, MOST).astype(np.int64)
    log_weight = np.log(np.maximum(weight, 1e-300))
    order = np.argsort(few, kind="stable")
    for k, at in zip(*_groups(few[order], order), strict=True):
        if k < 2:
            continue
        for some in np.array_split(at, max(1, len(at) * k // 2_000_000)):
            score = table[k, 1 : k + 1][None, :] + log_weight[some][:, None] * np.arange(1, k + 1)
            t[some] = (score + rng.gumbel(size=score.shape)).argmax(1) + 1
    at, seated = np.flatnonzero(n > MOST), MOST
    while len(at):
        more = np.minimum(n[at] - seated, seated)
        p = weight[at] / (weight[at] + np.maximum(seated + more / 2 - discount * t[at], 1e-9))
        t[at] += rng.binomial(more.astype(np.int64), p)
        seated *= 2
        at = at[n[at] > seated]
    return t


def _groups(values: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return values[np.concatenate([[0], cuts])].tolist() if len(values) else [], np.split(order, cuts) if len(values) else []


#: A context's tables in other shards are taken to grow as in this one, which counts for as many tables of the average growth.
STEADY = 16


def _sampler(totals: Totals, shards: int, burn: int, sweeps: int):
    """mapInArrow over (shard, number, data) sorted by both, each shard's counts first (number -1), then the replies of :func:`restaurants`: Gibbs sweeps over its dishes."""

    def sample(shard: int, data: bytes, replies: list[bytes]) -> pa.RecordBatch:
        words, word, pairs, _, _ = _thawed(data)
        contexts_, u, _ = _of_contexts(pairs["u"], shards)
        n, everywhere = pairs["n"], np.concatenate([unplanes(thaw(x)[0], "<f4") for x in replies]).astype(float)
        rng = np.random.default_rng(shard)
        t, many = np.ones(len(n)), np.flatnonzero(n > 1)
        count = lambda x: np.bincount(word, x, len(words))
        k, r, sums = count(t), np.ones(len(words)), [np.zeros(len(n)), np.zeros(len(words))]
        begun = np.bincount(u, t, len(contexts_))
        tables, others = everywhere, everywhere - begun
        base = (totals.strength + totals.root_discount * totals.roots) / (totals.words + 1)
        for sweep in range(burn + sweeps):
            away = k[word[many]] - t[many]  # the parent without this dish's tables here
            parent = totals.parent_of(np.maximum(away, 0), np.where(away > 0, np.minimum(r[word[many]], away), 0))
            t[many] = seat(n[many], (totals.strength + totals.discount * tables[u[many]]) * parent, totals.discount, rng)
            k = count(t)
            r = seat(k, np.full(len(k), base), totals.root_discount, rng)
            here = np.bincount(u, t, len(contexts_))
            tables = here + others * (here + STEADY * t.sum() / len(t)) / (begun + STEADY)
            if sweep >= burn:
                for s, x in zip(sums, (t, r), strict=True):
                    s += x / sweeps
        pairs["t"] = sums[0]
        return _fitted_batch(shard, words, word, pairs, count(pairs["t"].astype(np.float64)), sums[1])  # as stored, so that the sums agree

    def run(batches):
        shard, counts, replies = None, None, []
        for at, number, data in _by_shard(batches):
            if number < 0:
                if shard is not None:
                    yield sample(shard, counts, replies)
                shard, counts, replies = at, data, []
            else:
                replies.append(data)
        if shard is not None:
            yield sample(shard, counts, replies)

    return run


def _sums(table: DataFrame) -> np.ndarray:
    """Sums over all shards: seven numbers reach the driver."""
    out = np.zeros(7)
    for r in table.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def _totals(sums: np.ndarray, before: Totals | None = None) -> Totals:
    customers, tables, one, two, words, parent, roots = sums.tolist()
    if before:
        return Totals(parent, roots, int(words), int(customers), before.discount, before.root_discount, before.strength)
    discount = float(np.clip(one / (one + 2 * two), 0.1, 0.9)) if one else 0.5
    return Totals(tables, words, int(words), int(customers), discount, discount)


@dataclass(frozen=True)
class Model:
    """table: FITTED rows, one for each shard; tables: of contexts, of :func:`restaurants`."""

    table: DataFrame
    tables: DataFrame
    totals: Totals


def fit(rows: DataFrame, shards: int, burn: int = 3, sweeps: int = 4) -> Model:
    """rows: shard, chunk, data of :func:`_chunks`."""
    dealt = rows.select("shard", "chunk", "data").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    merged = materialize(map_batches(dealt, _merge, FITTED), "counts")
    sweep(rows.sparkSession)
    totals = _totals(_sums(merged))
    counts = merged.filter("size(sums) > 0 and sums[0] > 0").select("shard", F.lit(-1).cast("bigint").alias("number"), "data")
    asked = _dealt(counts.unionByName(restaurants(merged, shards, True)), shards)
    table = materialize(map_batches(asked, _sampler(totals, shards, burn, sweeps), FITTED), "seating")
    release(merged)
    return Model(table, restaurants(table, shards, False), _totals(_sums(table), totals))


# --- scoring ---

#: Of a chunk's words: count, parent's probability, tables as a context; of its pairs: c_uw - d t_uw.
ANSWER = ("<u8", "<f4", "<f4", "<f4")


def _answers(totals: Totals, book: Codebook):
    """mapInArrow over (shard, number, data) sorted by both, each shard's seating first (number -2), then its contexts' tables (-1), then chunks: of the chunk's words counts, parent's probabilities and tables as a context; of its pairs c_uw - d t_uw."""

    def run(batches):
        shard = None
        for at, number, data in _by_shard(batches):
            if at != shard:
                shard, known, h, tables = at, {}, np.zeros(0, np.uint64), np.zeros(0)
                of, u, own, start, parent, count = np.zeros(0, np.int64), h, tables, np.zeros(1, np.int64), tables, tables
            if number == -2:
                words, of, pairs, k, r = _thawed(data)
                known = dict(zip(words, range(len(words)), strict=True))
                u, own = pairs["u"].copy(), pairs["n"] - totals.discount * pairs["t"]
                count, parent = np.bincount(of, pairs["n"], len(words)), totals.parent_of(k, r)
                start = np.searchsorted(of, np.arange(len(words) + 1))
                continue
            if number == -1:
                t, *codes = thaw(data)
                h, tables = unpack(*codes), unplanes(t, "<f8")
                continue
            lengths, names, sizes, _, *asked = thaw(data)
            names, asked, sizes = _names(lengths, names), unpack(*asked), unplanes(sizes, "<u4")
            place = np.array([known.get(w, -1) for w in names], np.int64)
            seen = place >= 0
            counts, parents, as_context = np.zeros(len(place)), np.full(len(place), totals.parent_of(np.zeros(1), np.zeros(1))[0]), np.zeros(len(place))
            counts[seen], parents[seen] = count[place[seen]], parent[place[seen]]
            if len(h):
                hashes = book.codes(names)
                hit = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
                as_context = np.where(h[hit] == hashes, tables[hit], 0)
            word = np.repeat(place, sizes)
            low, high = start[np.maximum(word, 0)].copy(), np.where(word >= 0, start[np.maximum(word, 0) + 1], 0) if len(u) else np.zeros(len(word), np.int64)
            last = high
            while (low < high).any():  # binary search among each word's contexts
                mid = (low + high) // 2
                less = (low < high) & (u[np.minimum(mid, len(u) - 1)] < asked)
                low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(mid, high))
            mine = np.zeros(len(word))
            if len(u):
                hit = np.minimum(low, len(u) - 1)
                mine = np.where((low < last) & (u[hit] == asked), own[hit], 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([shard]), pa.array([freeze(*(planes(x.astype(kind)) for x, kind in zip((counts, parents, as_context, mine), ANSWER, strict=True)))], pa.binary())], names=["chunk", "shard", "data"]
            )

    return run


def _scorer(totals: Totals):
    """cogroup by chunk: answers by shard, documents by place."""

    def run(answers: pa.Table, docs: pa.Table) -> pa.Table:
        parts = [thaw(x) for x in answers.sort_by("shard").column("data").to_pylist()]
        docs = docs.sort_by("place")
        lengths = docs.column("n").to_numpy()
        (tokens,) = thaw(docs.column("data")[0].as_py())
        tokens = unplanes(tokens, "<i4")
        count, parent, tables, own = (np.concatenate([unplanes(y, kind) for y in x]).astype(np.float64) for x, kind in zip(zip(*parts, strict=True), ANSWER, strict=True))
        before = contexts(tokens, lengths)
        _, at = np.unique(tokens.astype(np.int64) << SHIFT | before, return_inverse=True)  # the order in which the pairs were asked
        logs = np.log10(totals.predictive(own[at], parent[tokens], count[before], tables[before]))
        base = np.log10((count + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))[tokens]
        starts = np.cumsum(lengths) - lengths
        add = lambda x: pa.array(np.add.reduceat(x, starts))
        return pa.table({"id": docs.column("id"), "n_tokens": pa.array(lengths), "n_known": add((count > 0)[tokens].astype(np.int64)), "base_score": add(base), "score": add(logs)})

    return run


def score(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, shard: int = SHARD, burn: int = 3, sweeps: int = 4) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every document; ``learn``: a column, true for rows to learn from.

    There is a shard of words for each ``shard`` bytes of text, so that shards stay of one size.
    """
    rows = docs.select(F.col(id_col).alias("id"), learn.alias("learn"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards, book = 1 + size // shard, codebook(rows, size)
    rows = _chunks(rows, chunk, shards, book).withColumn("place", F.monotonically_increasing_id()).withColumn("kind", F.when(F.col("shard").isNull(), "texts").otherwise("words"))
    texts_, words = materialize_by(rows, "kind", ["texts", "words"], "chunks")
    asked = words.select("shard", "chunk", "data")
    model = fit(words.filter("learn"), shards, burn, sweeps)
    sweep(docs.sparkSession)
    seating = model.table.select("shard", F.lit(-2).cast("bigint").alias("number"), "data")
    dealt = _dealt(seating.unionByName(model.tables).unionByName(asked.withColumnRenamed("chunk", "number")), shards)
    answers = materialize(map_batches(dealt, _answers(model.totals, book), "chunk bigint, shard bigint, data binary"), "answers")
    release(words)
    release(model.table)
    sweep(docs.sparkSession)
    texts_ = texts_.select("chunk", "place", "id", "n", "data")
    kind = docs.schema[id_col].dataType.simpleString()
    parts = 1 + size // (2 * chunk)  # as many as keep a few chunks in each
    out = answers.repartition(parts, "chunk").groupBy("chunk").cogroup(texts_.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(_scorer(model.totals), f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(model.totals.tokens)).cast("bigint").alias("train_tokens"), "base_score", "score")
