"""BPE encoding by a distinct-word table, decoding by a join of ids with pieces.

Encoding: texts are cut into words where the tokenizer cuts them. A chunk of texts is kept as numbers of
its own words, next to the list of those words; lists are dealt out by hash of the word, so that all chunks'
entries of a word meet, and there the tokenizer encodes each distinct word once. Its ids go back to each
chunk that has the word and are joined to the words' places by number. Chunks are written in buckets, so the
numbers, about a byte and a half a word, aren't shuffled; what is shuffled, there and back, is an entry for
each distinct word of a chunk, packed by chunk and bucket of words, whose number follows the size of the
table. A frequent word is one entry a chunk.

Decoding: ids are joined with the vocabulary's pieces in the tasks, batch by batch, and a text's pieces put
together in order. The pieces, as many as the tokenizer's file has, are sent to every task; no shuffle.

Defined results: a null or empty text has no ids and decodes to the empty text. Repeated rows are encoded
each on its own. Texts of any length are encoded whole; a chunk ends with the text that fills it, so a
task holds a chunk and its longest text. An empty table gives no rows. Ids that the vocabulary lacks and
null ids decode to nothing; bytes that aren't UTF-8 decode to U+FFFD. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from causeway.llm.common import map_batches, materialize, materialize_buckets, release, sweep
from causeway.session import ship

#: Characters of a chunk of texts, and of the texts for each bucket of words.
CHUNK, BUCKET = 12 << 20, 8 << 20
LONG = 1 << 20
ENCODED_AT_ONCE, PLACED_AT_ONCE, DECODED_AT_ONCE = 2_000, 500_000, 500_000
#: How byte-level tokenizers of this kind cut a text.
CUTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Blocks of code points that have long been settled. Elsewhere versions of Unicode differ in what is a letter, so the tokenizer itself cuts such texts.
SETTLED = regex.compile(r"[\u0000-\u0557\u2000-\u206f\u20a0-\u2bff\u3000-\ua48f\uac00-\ud7a3\uff00-\uffef]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words:
    """Cuts texts into the words that a byte-level tokenizer encodes each on its own, and encodes them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        cut = parts.get("pre_tokenizer") or {}
        if parts.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("not a byte-level tokenizer that cuts texts into words: " + path)
        added = parts.get("added_tokens", [])
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens that take spaces or whole words")
        whole = sorted((x["content"] for x in added), key=len, reverse=True)
        self.whole = regex.compile("(" + "|".join(map(regex.escape, whole)) + ")") if whole else None

    def cut(self, text: str) -> Iterator[str]:
        parts = self.whole.split(text) if self.whole else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield part
            elif not SETTLED.fullmatch(part):
                yield from (part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
            elif len(part) > LONG:
                yield from (m.group() for m in CUTS.finditer(part))
            else:
                yield from CUTS.findall(part)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_loaded: dict[str, Words] = {}


def words_at(path: str) -> Words:
    """One for each Python worker, which keeps it from task to task."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


#: Numbers below the first take a byte, those below the second two.
ONE, TWO = 192, 192 + 63 * 256


def _squeeze(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of numbers below 2**32, mostly small, and ``tail``. First bytes, second bytes and whole large numbers lie apart."""
    parts = [len(columns).to_bytes(4, "little")]
    for numbers in columns:
        x = numbers.astype(np.int64)
        two, large = (x >= ONE) & (x < TWO), x >= TWO
        first = np.where(x < ONE, x, np.where(two, ONE + (x - ONE >> 8), 255)).astype(np.uint8)
        rest = np.ascontiguousarray(x[large].astype("<u4").view(np.uint8).reshape(-1, 4).T)
        parts += [n.to_bytes(4, "little") for n in (len(x), int(two.sum()), int(large.sum()))]
        parts += [first.tobytes(), ((x[two] - ONE) & 255).astype(np.uint8).tobytes(), rest.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, tail]))


def _unsqueeze(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        n, twos, larges = (int.from_bytes(raw[at + 4 * k : at + 4 * k + 4], "little") for k in range(3))
        at += 12
        x = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        two, large = (x >= ONE) & (x < 255), x == 255
        x[two] = ONE + (x[two] - ONE << 8 | np.frombuffer(raw, np.uint8, twos, at + n))
        x[large] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * larges, at + n + twos).reshape(4, larges).T).view("<u4").ravel()
        out.append(x)
        at += n + twos + 4 * larges
    return out, raw[at:]


def encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_loaded: dict[str, Words] = {}


def words_at(path: str) -> Words:
    """One for each Python worker, which keeps it from task to task."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def _squeeze(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of small numbers, bytes of equal weight side by side as the high ones are nearly all zero, and ``tail``."""
    parts = [len(columns).to_bytes(4, "little")]
    for numbers in columns:
        parts += [len(numbers).to_bytes(4, "little"), np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, tail]))


def _unsqueeze(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        n = int.from_bytes(raw[at : at + 4], "little")
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 4)
        out.append(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel())
        at += 4 + 4 * n
    return out, raw[at:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """One row per document: id and ``ids`` (array of int), as the tokenizer encodes the whole text without special tokens at its ends."""
    path = tokenizer or default_tokenizer()
    words_at(path)  # an unfit tokenizer fails here
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    table = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    chars = table.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // bucket))

    def run(batches):
        words, task, made = words_at(path), TaskContext.get().partitionId(), 0
        keys, counts, coded, numbers, held = [], [], [], _Numbers(), 0

        def flush():
            nonlocal made, keys, counts, coded, numbers, held
            codes = np.concatenate(coded)
            order = np.argsort(-np.bincount(codes, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            name, listed = task << 33 | made, [w.encode() for w in numbers]
            made += 1
            yield _rows("text", name, [-1], pa.nulls(1, keys[0].type), [len(codes)], [_squeeze(rank[codes])])
            yield _rows("text", name, range(len(counts)), pa.concat_arrays(keys), counts, [None] * len(counts))
            for at, entry in _dealt(listed, rank, buckets):
                yield _rows("word", name, [at], pa.nulls(1, keys[0].type), [0], [entry])
            keys, counts, coded, numbers, held = [], [], [], _Numbers(), 0

        for b in batches:
            for i, value in enumerate(b.column(1)):
                text = value.as_py()
                found = np.fromiter(map(numbers.__getitem__, words.cut(text or "")), np.uint32)
                keys.append(b.column(0).slice(i, 1))
                counts.append(len(found))
                coded.append(found)
                held += len(text or "")
                if held >= chunk or len(counts) >= 50_000:
                    yield from flush()
        if counts:
            yield from flush()

    cut = map_batches(table, run, f"kind string, chunk bigint, at int, key {kind.simpleString()}, n int, data binary")
    texts, words = materialize_buckets(cut, "kind", ["text", "word"], "chunk", max(1, -(-chars // chunk)), "bpe")

    def encoded(group: pa.Table) -> pa.Table:
        """All chunks' words of a bucket: each distinct one is encoded once."""
        entries = [_listed(x) for x in group.column("data").to_pylist()]
        distinct = list(dict.fromkeys(w for _, own in entries for w in own))
        ids: dict[bytes, np.ndarray] = {}
        for at in range(0, len(distinct), ENCODED_AT_ONCE):
            part = distinct[at : at + ENCODED_AT_ONCE]
            ids.update(zip(part, words_at(path).encode([str(w, "utf-8") for w in part]), strict=True))
        packed = []
        for rank, own in entries:
            found = [ids[w] for w in own]
            packed.append(_squeeze(np.diff(rank, prepend=0), np.array([len(x) for x in found]), np.concatenate(found)))
        return pa.table([group.column("chunk"), pa.array(packed, pa.binary())], names=["chunk", "data"])

    ship(spark)
    placed = materialize(words.select("chunk", "at", "data").groupBy("at").applyInArrow(encoded, "chunk bigint, data binary"), "bpe-ids")
    release(words)
    sweep(spark)

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at")
        (codes,), _ = _unsqueeze(left.column("data")[0].as_py())
        entries = [_unsqueeze(x)[0] for x in right.column("data").to_pylist()]
        none = np.zeros(0, np.int64)
        rank, sizes, flat = (np.concatenate([none, *column]).astype(np.int64) for column in (zip(*((np.cumsum(r), n, ids) for r, n, ids in entries), strict=True) if entries else ([none],) * 3))
        lengths, starts = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        lengths[rank], starts[rank] = sizes, np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        put = np.empty(ends[-1], np.int32)
        for a in range(0, len(codes), PLACED_AT_ONCE):
            b = min(len(codes), a + PLACED_AT_ONCE)
            spread = np.repeat(starts[codes[a:b]] - ends[a:b], lengths[codes[a:b]])
            spread += np.arange(ends[a], ends[b])
            put[ends[a] : ends[b]] = flat[spread]
        rows = left.slice(1)
        bounds = np.concatenate([[0], np.cumsum(rows.column("n").to_numpy())])
        ids = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(put))
        return pa.table([rows.column("key"), ids], names=["key", "ids"])

    out = texts.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(put_together, f"key {kind.simpleString()}, ids array<int>")
    out = out.withColumnRenamed("key", id_col)
    out._causeway_parts = (texts, placed)
    return out


def _dealt(words: list[bytes], rank: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """A chunk's words by bucket: numbers in ascending order, lengths, and the words one after the other."""
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
    order = np.lexsort((rank, of))
    sizes = np.bincount(of, minlength=buckets)
    for at, (end, n) in enumerate(zip(np.cumsum(sizes), sizes, strict=True)):
        if n:
            own = order[end - n : end]
            listed = [words[i] for i in own]
            yield at, _squeeze(np.diff(rank[own].astype(np.int64), prepend=0), np.array([len(w) for w in listed]), tail=b"".join(listed))


def _listed(entry: bytes) -> tuple[np.ndarray, list[bytes]]:
    (gaps, sizes), raw = _unsqueeze(entry)
    ends = np.cumsum(sizes).tolist()
    return np.cumsum(gaps), [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def forget(encoded: DataFrame) -> None:
    """Delete the scratch tables behind what :func:`encode` returned, once its rows are written."""
    for part in getattr(encoded, "_causeway_parts", ()):
        release(part)


def _rows(kind: str, chunk: int, at, keys: pa.Array, counts: list[int], data: list[bytes | None]) -> pa.RecordBatch:
    n = len(counts)
    columns = [pa.array([kind] * n), pa.array([chunk] * n, pa.int64()), pa.array(list(at), pa.int32()), keys, pa.array(counts, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "chunk", "at", "key", "n", "data"])


def _sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to ``DECODED_AT_ONCE`` ids, or one text."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy())
    at, before = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, before + DECODED_AT_ONCE, side="right")))
        yield batch.slice(at, to - at)
        at, before = to, ends[to - 1]


def pieces(tokenizer: str | None = None) -> pa.Table:
    """The vocabulary: id and piece (bytes), as many rows as the tokenizer's file has ids."""
    tok = words_at(tokenizer or default_tokenizer()).tokenizer
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(c): c for c in plain} | {chr(0x100 + i): c for i, c in enumerate(c for c in range(0x100) if c not in plain)}
    known = sorted((i, bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()) for piece, i in tok.get_vocab(with_added_tokens=True).items())
    return pa.table([pa.array([i for i, _ in known], pa.int32()), pa.array([p for _, p in known], pa.binary())], names=["id", "piece"])


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """The other columns of ``encoded`` and ``text``, what the ids decode to, special tokens included. ``ids`` is an array of int; null counts as empty."""
    if "text" in encoded.columns:
        raise ValueError("there is a column named text already")
    others = [c for c in encoded.columns if c != ids_col]
    table = pieces(tokenizer)

    def run(batches):
        known, piece = table.column("id").combine_chunks(), table.column("piece").combine_chunks()
        for b in (part for whole in batches for part in _sliced(whole, len(others))):
            ids = pc.fill_null(b.column(len(others)), pa.array([[]], pa.list_(pa.int32()))[0])
            joined = piece.take(pc.index_in(ids.flatten(), known))  # a null where the vocabulary has no such id
            at = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
            offsets = ids.offsets.to_numpy()
            ends = at[offsets - offsets[0]]
            data = memoryview(joined.buffers()[2] or b"")
            whole = [str(data[x:y], "utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(whole, pa.string())], names=[*others, "text"])

    schema = StructType([*(encoded.schema[c] for c in others), StructField("text", StringType())])
    return map_batches(encoded.select(*(F.col(f"`{c}`") for c in [*others, ids_col])), run, schema)
