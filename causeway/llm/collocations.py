"""Phrase collocations: candidates from a sketch, counted exactly by automata, scored on exact integers.

1. Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and ``\\x0A-\\x0D`` and into words at spaces
   and tabs, and written as units of one language each: words with a space on either side, pieces parted by
   a newline that stands like a word. Each unit adds its phrases to a count-min sketch of one row, whose
   width follows the size of the table; a unit sends its own cells, block by block.
2. A block of the sketch is summed by one group, which answers each unit with those of its cells whose sum
   reaches the least count: an upper bound of the count of every phrase in that cell.
3. A unit's phrases in such cells are its candidates. They are compiled, with their spaces as guards, into
   Aho-Corasick automata of a bounded size, and the unit is scanned for all their matches, overlapping ones
   too. Counts are summed over the units, and thresholds are applied to the sums. A phrase with the least
   count lies in a cell that passes for every unit that holds it, so its sum is its whole count.

Scores: of phrases of 2 to ``longest`` words with a = f(phrase) >= ``least``; a cut after k words gives l
and r, and score floor(1000000 * a * a / (l * r)); the lowest cut counts, ties to the smallest k. Phrases
whose words lie inside a longer one with 100 * f(longer) >= ``covered`` * a are dropped.

Defined results: a null or empty text has no words; a null language is ``und``. Texts of any length are read
whole: a unit is cut where a piece ends, so a task holds a unit and its longest piece. Repeated rows count
each. Ties rank by count, then phrase. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import map_batches, materialize, materialize_by, release, sweep
from causeway.session import ship

UNIT = 8 << 20
#: Cells of a block; keys of an automaton in characters, some 50 bytes each; characters of the texts for each bucket of counts.
BLOCK_BITS, KEYS, BUCKET = 20, 3_000_000, 4 << 20
BREAK = b"\n"
MARKS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def laid_out(text: bytes) -> bytes:
    """Words with one space on either side; a newline that stands like a word where a piece ends."""
    words = text.translate(MARKS).replace(BREAK, b" \n ").split(b" ")
    return b" " + b" ".join([*filter(None, words), BREAK]) + b" "


class Unit:
    """Words of a unit by number, and the cells of its phrases."""

    def __init__(self, text: bytes):
        words = text[1:-1].split(b" ")
        numbers = dict.fromkeys(words)
        self.words = list(numbers)
        for i, w in enumerate(self.words):
            numbers[w] = i
        self.seq = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.real = self.seq != numbers.get(BREAK, -1)

    def phrases(self, longest: int, lang: str, bits: int):
        """Of each length from 1: where its phrases begin, their cells and their numbers, occurrence by occurrence."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        marks = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))[self.seq]
        hashed, fit, ids = marks, self.real, self.seq
        spread = lambda h: ((h ^ (h >> np.uint64(32))) * EVEN[1]) >> np.uint64(64 - bits)
        with np.errstate(over="ignore"):
            yield 1, np.flatnonzero(fit), spread(marks)[fit].astype(np.int64), ids[fit]
        for k in range(2, longest + 1):
            n = len(self.seq) - k + 1
            if n < 1:
                return
            fit = fit[:n] & self.real[k - 1 :]
            with np.errstate(over="ignore"):
                hashed = (hashed[:n] ^ (hashed[:n] >> np.uint64(29))) * EVEN[0] + marks[k - 1 :]
                cells = spread(hashed)
            first, ids = ids[:n], self.seq[k - 1 :]
            pairs = first * (int(ids.max()) + 1) + ids if int(first.max()) * (int(ids.max()) + 1) < 1 << 62 else None
            if pairs is None:
                raise RuntimeError("a unit has too many words")
            ids = np.unique(pairs, return_inverse=True)[1] if k < longest else pairs
            yield k, np.flatnonzero(fit), cells[fit].astype(np.int64), ids[fit]


def count_type(least: int) -> type:
    """Counts are sent up to what it holds: never less than ``least``, so sums that are cut off pass anyway."""
    return np.uint8 if least <= 255 else np.uint32


def sketch_rows(unit: int, u: Unit, lang: str, least: int, longest: int, bits: int, name: str) -> pa.RecordBatch:
    """A unit's cells and their counts, a row for each block."""
    kind = count_type(least)
    cells = np.concatenate([c for *_, c, _ in u.phrases(longest, lang, bits)] or [np.zeros(0, np.int64)])
    cells, counts = np.unique(cells, return_counts=True)
    blocks, firsts = np.unique(cells >> BLOCK_BITS, return_index=True)
    data = []
    for a, b in zip(firsts, [*firsts[1:], len(cells)][: len(firsts)], strict=True):
        data.append(_packed(cells[a:b] & ((1 << BLOCK_BITS) - 1)) + np.minimum(counts[a:b], np.iinfo(kind).max).astype(kind).tobytes())
    n = len(blocks)
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([unit] * n, pa.int64()), pa.nulls(n, pa.string()), pa.array(blocks.astype(np.int64)), pa.array(data, pa.binary())], names=["kind", "unit", "lang", "block", "data"])


def _packed(spots: np.ndarray) -> bytes:
    """Ascending numbers below 2**24 by their low, middle and high bytes' planes, after their count: differences, so that high planes are mostly zero."""
    gaps = np.diff(spots, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]
    return len(spots).to_bytes(4, "little") + np.ascontiguousarray(gaps).tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(blob, np.uint8, 3 * n, 4).reshape(3, n).astype(np.int64)
    return np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16), blob[4 + 3 * n :]


def scan(text: bytes, lang: str, hot: np.ndarray, longest: int, bits: int, keys: int = KEYS) -> tuple[list[bytes], list[int]]:
    """Candidates of a unit, which are its words and phrases in ``hot`` cells, and how often each occurs there. Single words are counted as they are numbered."""
    u, hot = Unit(text), np.sort(hot)
    out, sums, found = [], [], []
    for k, at, cells, ids in u.phrases(longest, lang, bits):
        if not len(hot):
            break
        passed = hot[np.minimum(np.searchsorted(hot, cells), len(hot) - 1)] == cells
        numbers, first, n = np.unique(ids[passed], return_index=True, return_counts=True)
        at = at[passed][first]
        if k == 1:
            out += [u.words[i] for i in numbers]
            sums += n.tolist()
        else:
            parts = [[u.words[i] for i in u.seq[at + j]] for j in range(k)]
            found += [b" ".join(p).decode("latin-1") for p in zip(*parts, strict=True)]
    line = text.decode("latin-1")
    at = 0
    while at < len(found):
        automaton, size, first = ahocorasick.Automaton(), 0, at
        while at < len(found) and (size < keys or at == first):
            automaton.add_word(f" {found[at]} ", at - first)
            size += len(found[at]) + 2
            at += 1
        automaton.make_automaton()
        hits = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(line)), np.int64), minlength=at - first)
        sums += hits.tolist()
    return out + [x.encode("latin-1") for x in found], sums


def counts(docs: DataFrame, least: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang", unit: int = UNIT) -> DataFrame:
    """Whole counts of all words and phrases of up to ``longest`` words that occur ``least`` times or more: lang, ``size`` in words, phrase, n; and of all words together, with size 0 and no phrase."""
    spark = docs.sparkSession
    table = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    chars = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(56, max(BLOCK_BITS, (chars // 2).bit_length()))  # as many cells as phrases, about

    def prepare(batches):
        task, made, waiting, held = TaskContext.get().partitionId(), 0, {}, 0

        def units(lang):
            nonlocal made, held
            line = b"".join(waiting.pop(lang))
            held -= len(line)
            at = 0
            while at < len(line):
                to = line.find(b" \n ", at + unit)
                to = len(line) if to < 0 else to + 3
                part = line[at:to] if at == 0 else b" " + line[at:to]
                u = Unit(part)
                name = task << 33 | made
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["unit"]), pa.array([name], pa.int64()), pa.array([lang], pa.string()), pa.array([int(u.real.sum())], pa.int64()), pa.array([zstandard.ZstdCompressor(level=6).compress(part)], pa.binary())],
                    names=["kind", "unit", "lang", "block", "data"],
                )
                yield sketch_rows(name, u, lang, least, longest, bits, "cells")
                at = to

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                if not t:
                    continue
                line = laid_out(t.encode())
                line = line if lang not in waiting else line[1:]
                waiting.setdefault(lang, []).append(line)
                held += len(line)
                while held >= unit and waiting:
                    yield from units(max(waiting, key=lambda x: sum(map(len, waiting[x])))) if len(waiting) > 1 else units(lang)
        for lang in list(waiting):
            yield from units(lang)

    parts = map_batches(table, prepare, "kind string, unit bigint, lang string, block bigint, data binary")
    texts, cells = materialize_by(parts, "kind", ["unit", "cells"], "phrases")

    def answer(group: pa.Table) -> pa.Table:
        sums, blobs = np.zeros(1 << BLOCK_BITS, np.int64), group.column("data").to_pylist()
        for blob in blobs:
            spots, rest = _unpacked(blob)
            sums[spots] += np.frombuffer(rest, count_type(least))
        hot, unit_ids, data = sums >= least, [], []
        for name, blob in zip(group.column("unit").to_pylist(), blobs, strict=True):
            spots = _unpacked(blob)[0]
            if len(spots := spots[hot[spots]]):
                unit_ids.append(name)
                data.append(_packed(spots))
        block = group.column("block")[0].as_py()
        return pa.table({"unit": pa.array(unit_ids, pa.int64()), "block": pa.array([block] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})

    ship(spark)
    answers = materialize(cells.select("unit", "block", "data").groupBy("block").applyInArrow(answer, "unit bigint, block bigint, data binary"), "hot")
    release(cells)
    sweep(spark)

    buckets = max(1, -(-chars // BUCKET))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        text, lang = zstandard.ZstdDecompressor().decompress(left.column("data")[0].as_py()), left.column("lang")[0].as_py()
        hot = [_unpacked(x)[0] + (b << BLOCK_BITS) for b, x in zip(right.column("block").to_pylist(), right.column("data").to_pylist(), strict=True)]
        dealt = _dealt(*scan(text, lang, np.concatenate(hot) if hot else np.zeros(0, np.int64), longest, bits), buckets)
        return pa.table({"lang": pa.array([lang] * len(dealt), pa.string()), "bucket": pa.array([b for b, _ in dealt], pa.int64()), "data": pa.array([x for _, x in dealt], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        """Whole counts of a bucket's phrases."""
        sums: dict[bytes, int] = {}
        for blob in group.column("data").to_pylist():
            for phrase, n in zip(*_gathered(blob), strict=True):
                sums[phrase] = sums.get(phrase, 0) + n
        kept = {p: n for p, n in sums.items() if n >= least}
        return pa.table({"lang": pa.array(group.column("lang").to_pylist()[:1] * len(kept), pa.string()), "phrase": pa.array(list(kept), pa.binary()).cast(pa.string()), "n": pa.array(list(kept.values()), pa.int64())})

    each = texts.select("unit", "lang", "data").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(match, "lang string, bucket bigint, data binary")
    whole = each.groupBy("lang", "bucket").applyInArrow(total, "lang string, phrase string, n bigint").withColumn("size", F.size(F.split("phrase", " ")))
    words = texts.groupBy("lang").agg(F.sum("block").alias("n")).select("lang", F.lit(None).cast("string").alias("phrase"), "n", F.lit(0).alias("size"))
    out = materialize(whole.unionByName(words), "counts")
    release(texts)
    release(answers)
    sweep(spark)
    return out


def _dealt(phrases: list[bytes], counts: list[int], buckets: int) -> list[tuple[int, bytes]]:
    """A unit's phrases in order, with their counts, packed by bucket."""
    of: dict[int, list[int]] = {}
    for i, p in enumerate(phrases):
        of.setdefault(xxhash.xxh3_64_intdigest(p) % buckets, []).append(i)
    out = []
    for b, own in of.items():
        own.sort(key=phrases.__getitem__)
        numbers = np.ascontiguousarray(np.array([counts[i] for i in own], "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        out.append((b, zstandard.ZstdCompressor(level=3).compress(len(own).to_bytes(4, "little") + numbers + BREAK.join(phrases[i] for i in own))))
    return out


def _gathered(blob: bytes) -> tuple[list[bytes], list[int]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    counts = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T).view("<u4").ravel()
    return raw[4 + 4 * n :].split(BREAK), counts.tolist()


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, covered: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", unit: int = UNIT) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and phrase: lang, rank, phrase, a, l, r, n, score."""
    counted = counts(docs, least, longest, text_col, lang_col, unit)
    total = counted.filter("size = 0").select("lang", F.col("n").alias("total"))
    often = counted.filter("size > 0")
    phrases = often.filter("size > 1").withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    part = lambda at, k: F.array_join(F.slice(words, at, k), " ")

    cuts = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    named = lambda name, n: often.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(named("first", "l"), ["lang", "first"]).join(named("rest", "r"), ["lang", "rest"])
    # quotients of up to 38 digits; score * l * r <= 10**6 * a * a holds for no larger score
    cuts = cuts.withColumn("score", F.expr("(1000000BD * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    own = F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda at: part(at, k)))
    longer = phrases.filter("size > 2").select("lang", "a", F.explode(F.flatten(own)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    scored = scored.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    out = ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    return out
