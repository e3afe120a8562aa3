"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: an ordinary one from the commonest words, and
a toxic one that adds the words whose segments stand far more often in toxic texts, most frequent last,
where matches cost least. Each word of a text is a window, compressed with either dictionary: between
the two lengths lies the distance. A carrier that both dictionaries hold follows the word, so that even
short words are worth a match. Pairs of distance and remaining length form buckets; log-odds of the
buckets, calibrated on labelled texts, weigh a text's windows, and a logistic function of their sum and
density gives the score.

Bounds: about ``toxic`` and ``ordinary`` labelled texts of up to ``longest`` characters teach; every
text is scored whole. Labels of held-out rows, languages, sources and ids are not inputs.

Defined results: null and empty texts have no windows and score like ordinary ones; without labelled
texts of both kinds all scores are 0. A document labelled twice counts as toxic if either label is.
Repeated rows are scored each on its own; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import LOWER, map_batches, texts

TOXIC, ORDINARY, LONGEST = 1500, 3000, 50_000
CARRIER = b" the carrier of each window stands in both dictionaries "
SEGMENT, LEVEL, REMEMBERED, SIDE = 5, 3, 400_000, 10


def segments(text: bytes, width: int = SEGMENT) -> np.ndarray:
    """Distinct runs of ``width`` bytes of the lower-cased, spaced text, as numbers."""
    b = np.frombuffer(b" " + b" ".join(text.translate(LOWER).split()) + b" ", np.uint8).astype(np.uint64)
    n = len(b) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        h = h * np.uint64(256) + b[i : n + i]
    return np.unique(h)


def _shares(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([segments(x) for x in docs]), return_counts=True)


def telling_words(toxic: list[bytes], ordinary: list[bytes], ratio: float = 8.0) -> Counter:
    """Words of toxic texts with a segment that is at least ``ratio`` times as frequent there."""
    g, n = _shares(toxic)
    o, m = _shares(ordinary)
    o, m = np.append(o, np.uint64(0)), np.append(m, 0)  # ordinary texts may have no segment at all
    at = np.searchsorted(o[:-1], g)
    m = np.where(o[at] == g, m[at], 0)
    share = ((n + 0.5) / (len(toxic) + 1)) / ((m + 0.5) / (len(ordinary) + 1))
    telling = set(g[(n >= max(3, 0.005 * len(toxic))) & (share >= ratio)].tolist())
    words = Counter(w for x in toxic for w in x.translate(LOWER).split())
    return Counter({w: k for w, k in words.items() if not telling.isdisjoint(segments(w).tolist())})


@dataclass(frozen=True)
class Distance:
    """Dictionaries' contents, bucket weights (SIDE by SIDE), and the logistic function of log-sum, density and 1."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    slope: np.ndarray

    @classmethod
    def train(cls, toxic: list[bytes], ordinary: list[bytes], words: int = 700, telling: int = 1500) -> Distance:
        common = Counter(w for x in ordinary for w in x.translate(LOWER).split()).most_common(words)
        base = b" " + b" ".join(w for w, _ in reversed(common))
        extra = b" ".join(w for w, _ in reversed(sorted(telling_words(toxic, ordinary).most_common(telling), key=lambda x: (-x[1], x[0]))))
        blank = cls(base + CARRIER, base + b" " + extra + CARRIER, np.zeros((SIDE, SIDE)), np.zeros(3))
        windows = Windows(blank)
        both = [[windows.buckets(x) for x in docs] for docs in (toxic, ordinary)]
        t, o = (sum(x) + 0.5 for x in both)
        weights = np.log((t / t.sum()) / (o / o.sum()))
        weights[(weights < 1) | (t < 3)] = 0
        rows = np.array([features(x, weights) for docs in both for x in docs])
        return cls(blank.ordinary, blank.toxic, weights, _logistic(rows, np.array([1.0] * len(toxic) + [0.0] * len(ordinary))))

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(features(buckets, self.weights) @ self.slope, -30, 30))))


def features(buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total, n = float((buckets * weights).sum()), float(buckets.sum())
    return np.array([np.log1p(total), 10 * total / (n + 20), 1.0])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; the classes weigh alike in sum."""
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Windows:
    """Buckets of a text's windows; those of words seen before are remembered, up to a bound."""

    def __init__(self, model: Distance):
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=4, format=zstandard.FORMAT_ZSTD1_MAGICLESS, dict_size=1 << 14, source_size=64
        )
        self.compress = []
        for content in (model.ordinary, model.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=options)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress)
        self.least = len(self.compress[1](CARRIER))
        self.known: dict[bytes, int] = {}

    def bucket(self, word: bytes) -> int:
        window = b" " + word + CARRIER
        ordinary, toxic = (len(f(window)) for f in self.compress)
        return min(max(ordinary - toxic, 0), SIDE - 1) * SIDE + min(max(toxic - self.least, 0), SIDE - 1)

    def buckets(self, text: bytes) -> np.ndarray:
        """Counts, SIDE (distance) by SIDE (length left with the toxic dictionary)."""
        words = text.translate(LOWER).split()
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.bucket(w)
        return np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=SIDE * SIDE).reshape(SIDE, SIDE)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, ordinary: int = ORDINARY, longest: int = LONGEST) -> Distance | None:
    """labels: id and label of the rows to learn from. A sample by a hash of the id reaches the driver, of the documented bounds."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    sizes = {r._label: r.n for r in marked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    h = F.pmod(F.xxhash64(id_col), F.lit(1 << 31)) / float(1 << 31)
    share = F.when(F.col("_label") == 1, min(1.0, toxic / sizes[1])).otherwise(min(1.0, ordinary / sizes[0]))
    drawn = F.broadcast(marked.filter(h < share).limit(2 * (toxic + ordinary)))  # bounded by the limit
    texts_ = docs.select(F.col(id_col), F.col(text_col)).filter(F.length(text_col) <= longest)
    got = texts_.join(drawn, id_col).select("_label", text_col).toArrow()
    sides: tuple[list[bytes], list[bytes]] = ([], [])
    for label, text in sorted(zip(got.column(0).to_pylist(), texts(got.column(1)), strict=True)):
        sides[label].append(text)
    return Distance.train(sides[1], sides[0]) if sides[0] and sides[1] else None


def score(docs: DataFrame, model: Distance | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score, predicted, windows flagged of every document."""

    def run(batches):
        windows = Windows(model) if model else None
        for b in batches:
            scores, flagged = [], []
            for x in texts(b.column(1)):
                counts = windows.buckets(x) if windows else None
                scores.append(model.score(counts) if windows else 0.0)
                flagged.append(int(counts[model.weights > 0].sum()) if windows else 0)
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(flagged, pa.int64())], names=["id", "score", "predicted", "flagged"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, score double, predicted int, flagged bigint")
