"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a linear classifier over hashed byte n-grams tells the
languages whose bit is 1 from the rest. Its weights are log-odds of n-gram frequencies, counted over a
bounded sample of labelled texts. Decoding sums each bit's logistic loss against the codeword,
weighted by how well the bit separates labelled texts that its weights weren't counted on, and takes the
nearest codeword; texts whose two nearest codewords are almost as near are flagged ambiguous.

Bounds: about ``sample`` texts teach each language; all languages are learned. Counts stay on the
executors; the driver gets the languages' names and sizes and the classifiers, whose number grows with
the logarithm of that of the languages. Every text is scored whole, however long.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there was nothing to
learn from. Rows with a null language teach nothing. Ties between codewords go to the first language by
code point. Repeated rows are scored each on its own; an empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import map_batches, materialize, release, texts

SAMPLE, BITS = 1500, 16
BLOCK = 8  # n-grams are learned in blocks of 2 ** BLOCK
LEAST_JUDGED = 8  # texts of a language from which on some are kept to judge the bits
_LETTER = re.compile(r"[^\W\d_]")
#: A-Z in lower case; other ASCII than letters to spaces; the rest as it is.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(text: bytes) -> bool:
    if len(text.translate(None, _ASCII_LETTERS)) < len(text):
        return True
    return not text.isascii() and _LETTER.search(text.decode("utf-8", "replace")) is not None


def grams(text: bytes) -> np.ndarray:
    """Hashes, below 2 ** BITS, of the byte trigrams and bigrams of the folded text."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    two = b[:-1] * np.uint32(0x01000193) ^ b[1:] * np.uint32(0x9E3779B1)
    three = two[:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    h = np.concatenate([two * np.uint32(0x27D4EB2F), three])
    return (h ^ h >> np.uint32(15)) >> np.uint32(32 - BITS)


def codewords(n: int, seed: int = 2) -> np.ndarray:
    """Languages by bits, +1 or -1: the exhaustive code up to 7 languages, else random columns."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        columns = np.arange(1, 1 << (n - 1))  # the first language's bits are all 1
        return np.array([[1 if k == 0 or not c >> (k - 1) & 1 else -1 for c in columns] for k in range(n)], float)
    rng = np.random.default_rng(seed)
    width = 10 * int(np.ceil(np.log2(n)))
    while True:
        code = rng.choice([-1.0, 1.0], (n, width))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        if len(np.unique(code, axis=0)) == n:
            return code


@dataclass(frozen=True)
class Ecoc:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # 2 ** BITS by bits
    trust: np.ndarray  # of bits

    def margins(self, text: bytes) -> np.ndarray:
        g = grams(text)
        total = np.zeros(self.code.shape[1])
        for at in range(0, len(g), 1 << 16):
            total += self.weights[g[at : at + (1 << 16)]].sum(0, dtype=np.float64)
        return total / np.sqrt(len(g) + 1)

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """Nearest codeword, its share of the likelihood, and whether the next is nearly as near."""
        loss = (np.logaddexp(0, -self.code * margins) * self.trust).sum(1)
        order = np.argsort(loss, kind="stable")
        score = 1 / np.exp(np.clip(loss[order[0]] - loss, -700, 0)).sum()
        return int(order[0]), float(score), bool(len(order) > 1 and loss[order[1]] - loss[order[0]] < 0.7)


def bit_weights(counts: np.ndarray, totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """N-grams by bits, from counts (languages by n-grams) and each language's n-grams in total: log-odds of the mean frequencies, clipped."""
    p = (counts + 0.05) / (totals + 0.05 * (1 << BITS))[:, None]
    one, zero = code > 0, code < 0
    if not zero.any():
        return np.zeros((counts.shape[1], code.shape[1]), np.float32)
    mean = lambda side: p.T @ side / side.sum(0)
    return np.clip(np.log(mean(one) / mean(zero)), -5, 5).astype(np.float32)


def _counted(drawn: DataFrame) -> DataFrame:
    """drawn: k, text. Counts k, gram, n."""

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                g = grams(text)
                if k not in total:
                    if len(total) >= 64:  # 32 MB
                        yield from _rows(total)
                        total = {}
                    total[k] = np.zeros(1 << BITS, np.int64)
                total[k] += np.bincount(g, minlength=1 << BITS)
        yield from _rows(total)

    return map_batches(drawn, count, "k bigint, gram bigint, n bigint").groupBy("k", "gram").agg(F.sum("n").alias("n"))


def _rows(total: dict[int, np.ndarray]):
    for k, seen in total.items():
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(seen[at])], names=["k", "gram", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Ecoc | None:
    """labelled: lang (not null), key, text. A sample of about ``sample`` texts of each language, by a hash of the key, teaches."""
    sizes = sorted((r.lang, r.n) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a language
    if not sizes:
        return None
    names, code = [x for x, _ in sizes], codewords(len(sizes))
    table = labelled.sparkSession.createDataFrame([(x, k, min(1.0, sample / n), n >= LEAST_JUDGED) for k, (x, n) in enumerate(sizes)], "lang string, k bigint, share double, many boolean")
    unit = lambda seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)
    drawn = labelled.join(F.broadcast(table) if len(sizes) <= 100_000 else table, "lang").filter(unit(0) < F.col("share"))
    drawn = drawn.select("k", "text", (F.col("many") & (unit(1) < 0.25)).alias("judge"))
    counts = materialize(_counted(drawn.filter("not judge").select("k", "text")), "grams")
    totals = np.zeros(len(names))
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row a language
        totals[r.k] = r.n

    def learn(block: pa.Table) -> pa.Table:
        gram, first = block.column("gram").to_numpy(), int(block.column("gram")[0].as_py()) >> BLOCK << BLOCK
        seen = np.zeros((len(names), 1 << BLOCK))
        seen[block.column("k").to_numpy(), gram - first] = block.column("n").to_numpy()
        return pa.table({"first": [first], "weights": pa.array([bit_weights(seen, totals, code).tobytes()], pa.binary())})

    weights = np.tile(bit_weights(np.zeros((len(names), 1)), totals, code), (1 << BITS, 1))  # of n-grams that no text has
    for r in counts.groupBy(F.shiftright("gram", BLOCK)).applyInArrow(learn, "first bigint, weights binary").collect():  # the model: 2 ** BITS by bits
        weights[r.first : r.first + (1 << BLOCK)] = np.frombuffer(r.weights, np.float32).reshape(-1, code.shape[1])
    release(counts)
    model = Ecoc(names, code, weights, np.ones(code.shape[1]))

    def judge(batches):
        right, n = np.zeros(code.shape[1], np.int64), 0
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                right += model.margins(text) * code[k] > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right))), pa.array(right), pa.array(np.full(len(right), n))], names=["bit", "good", "n"])

    judged = map_batches(drawn.filter("judge").select("k", "text"), judge, "bit bigint, good bigint, n bigint").groupBy("bit").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()
    share = np.full(code.shape[1], 0.5)
    for r in judged:
        share[r.bit] = (r.good + 1) / (r.n + 2)
    trust = np.log(share / (1 - share)).clip(0.1)
    return Ecoc(names, code, weights, trust / trust.mean())


def predict(docs: DataFrame, model: Ecoc | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, ambiguous of every document."""

    def run(batches):
        for b in batches:
            rows = []
            for text in texts(b.column(1)):
                if model is None or not has_letter(text):
                    rows.append(("und", 0.0, True))
                else:
                    k, score, doubt = model.decode(model.margins(text))
                    rows.append((model.languages[k], score, doubt))
            lang, score, doubt = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], names=["id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")
