"""Packing by power-of-two decomposition.

A document's token ids, with an end id, are cut into pieces whose lengths are powers of two: as many
of the longest as fit, then the bits of the rest from high to low. Each piece is a sequence of its
own, so no sequence crosses documents; sequences of one length form a bucket and need no padding.

Tokenizing works piece by piece: the tokenizer's pre-tokenizer cuts a text before its merges run, so the
ids of a text are those of its pieces in a row. Ids of pieces are remembered, up to a bound. That holds for
the default tokenizer's cuts; for others a text is encoded whole.

Defined results: a null or empty text has the end id alone, one piece of length 1. Repeated rows are
packed each on its own. Texts of any length are packed whole. An empty table gives no pieces. Further
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import map_batches, texts

REMEMBERED = 500_000
LONG_WORD, STEP = 64, 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Little-endian uint32 ids of whole texts, as the tokenizer gives them without special tokens.

    Text of printable ASCII and Latin-1 letters is lower-cased and cut where the tokenizer's
    pre-tokenizer cuts it; other words are encoded whole. Ids of these pieces are remembered in two
    generations of up to ``remembered`` each: what the old one holds moves to the young one when it is
    met again, so frequent pieces stay.
    """

    #: Of the tokenizer whose cuts PLAIN and PIECE follow. Texts for any other are encoded whole.
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMAL = ["NFC", "Replace", "Lowercase"]
    PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        normal, cuts = (parts.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        split = next((x for x in cuts.get("pretokenizers", []) if x["type"] == "Split"), {})
        self.known = [x["type"] for x in normal.get("normalizers", [])] == self.NORMAL and split.get("pattern") == {"Regex": self.CUTS} and split.get("behavior") == "Removed"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cut(self, text: bytes) -> list[str]:
        t = text.decode("utf-8", "replace")
        if self.PLAIN.fullmatch(t) and "<|" not in t:  # special tokens begin so
            return self.PIECE.findall(t.lower())
        out = []
        for word in text.split():
            w = word.decode("utf-8", "replace")
            out += self.PIECE.findall(w.lower()) if self.PLAIN.fullmatch(w) and "<|" not in w else [w]
        return out

    def _learn(self, keys: set[str]) -> set[str]:
        """Puts all ``keys`` in the young generation; returns the long ones among the new."""
        missing = keys.difference(self.young)
        if not missing:
            return missing
        if len(self.young) > self.remembered:
            self.young, self.old, missing = {}, self.young, keys
        found = self.old.keys() & missing
        self.young.update((k, self.old[k]) for k in found)
        if new := list(missing - found):
            got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.young.update((p, struct.pack(f"<{len(x.ids)}I", *x.ids)) for p, x in zip(new, got, strict=True))
        return {p for p in new if len(p) > LONG_WORD}

    def ids(self, text: bytes) -> bytes:
        if not self.known:
            ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        pieces = self.cut(text)
        seldom = self._learn(set(pieces))
        out = b"".join(map(self.young.__getitem__, pieces))
        for p in seldom:
            del self.young[p]
        return out


_loaded: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One for each Python worker, which keeps it from task to task."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def piece_lengths(n: int, longest: int = 2048) -> list[int]:
    """Powers of two that add up to ``n``, descending; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (binary, little-endian uint32), bucket, sequence_id, offset.

    ``bucket`` is the binary logarithm of the length: a batch is drawn from one bucket. No shuffle; each
    piece is numbered by its task and place in it.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path, end = tokenizer or default_tokenizer(), struct.pack("<I", end_id)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        words = tokenizer_at(path)
        for whole in batches:
            for at in range(0, len(whole), STEP):
                b, rows = whole.slice(at, STEP), ([], [], [], [], [])
                for i, text in enumerate(texts(b.column(1))):
                    tokens = words.ids(text) + end
                    n, start = len(tokens) // 4, 0
                    for k in piece_lengths(n, longest):
                        for column, x in zip(rows, (i, start, k, n, tokens[4 * start : 4 * (start + k)]), strict=True):
                            column.append(x)
                        start += k
                yield _piece_batch(b.column(0), rows)

    pieces = map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, start bigint, length bigint, doc_tokens bigint, ids binary")
    return pieces.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )


def _piece_batch(ids: pa.Array, rows: tuple[list, ...]) -> pa.RecordBatch:
    at, start, length, total, tokens = rows
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(tokens, pa.binary())], names=["id", "start", "length", "doc_tokens", "ids"]
    )
