"""Quality rules under weak supervision.

Each rule looks at counts of one text and votes good (+1), bad (-1) or abstains (0). Nine rules look for
a kind of fault of their own; four witnesses vote on loose signs that many good texts show too (letters
beyond ASCII, a repeated sentence or line, brevity), which only count beside other votes. A label model
tells for each kind of fault the texts that have it from those that don't, by every rule's and witness's
rates of votes in both. It is fitted by expectation-maximisation to the counts of all vote patterns (at
most 3 ** 9 * 2 ** 4, whatever the corpus), and a document is kept when the posterior probability of
quality reaches ``threshold``, instead of having to pass every rule: bad votes of witnesses alone don't
reject, and one of a rule only does as far as the other votes bear it out.

Defined results: a null or empty text has no words, so the length rule votes bad and the base check
fails it. Texts are counted whole, however long. Ties: a posterior equal to the threshold keeps.
Repeated rows are judged each on its own, alike. An empty table gives an empty result. Further columns
are ignored by :func:`score_quality` and passed through by :func:`filter_quality`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import WHITE, map_batches, materialize, texts

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_bars", "n_stutters")
WINDOW = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found at least twice, all occurrences counted.

    A hash of each window finds candidates; their words are then compared, so collisions do no harm.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = sum(h[k : k + n] * _ODD[k % 5] for k in range(width))
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice)).tolist()
    keys = [tuple(words[i : i + width]) for i in at]
    seen = Counter(keys)
    edges = np.zeros(len(words) + 1, np.int64)
    for i, k in zip(at, keys, strict=True):
        if seen[k] > 1:
            edges[i] += 1
            edges[i + width] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def features(text: bytes) -> tuple[int, ...]:
    """The counts named in FEATURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    return (
        len(words),
        len(text.translate(None, WHITE).decode("utf-8", "replace")),
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        size - len(text.translate(None, UPPER)),
        size - len(text.translate(None, LETTERS)),
        text.count(b"!") + text.count(b"?"),
        text.count(b"|"),
        sum(map(eq, words, words[1:])),
    )


def _between(x: np.ndarray, good: float, bad: float) -> np.ndarray:
    """+1 up to ``good``, -1 above ``bad``, else 0."""
    return np.where(x > bad, -1, np.where(x <= good, 1, 0))


def _rules() -> dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]]:
    per_word = lambda f, k: f[k] / np.maximum(f["n_words"], 1)

    def length(f):
        return np.where(f["n_words"] < 10, -1, np.where(f["n_words"] >= 40, 1, 0))

    def word_length(f):
        x = per_word(f, "word_chars")
        return np.where((x < 2) | (x > 14), -1, np.where((x >= 3) & (x <= 10), 1, 0))

    def capitals(f):
        return np.where(f["n_letters"] < 20, 0, _between(f["n_upper"] / np.maximum(f["n_letters"], 1), 0.2, 0.5))

    def lines(f):
        return np.where(f["n_lines"] < 4, 0, _between(f["n_dup_lines"] / np.maximum(f["n_lines"], 1), 0.1, 0.5))

    return {
        "length": length,
        "symbols": lambda f: _between(per_word(f, "n_symbols"), 0.05, 0.2),
        "repeats": lambda f: _between(per_word(f, "n_repeat_words"), 0.1, 0.2),
        "lines": lines,
        "word_length": word_length,
        "capitals": capitals,
        "marks": lambda f: _between(per_word(f, "n_marks"), 0.1, 0.4),
        "bars": lambda f: _between(per_word(f, "n_bars"), 0.05, 0.2),
        "stutters": lambda f: _between(per_word(f, "n_stutters"), 0.05, 0.3),
    }


def _witnesses() -> dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]]:
    """Loose signs of a fault: bad or good, never silent."""
    against = lambda sign: np.where(sign, -1, 1)
    return {
        "letters": lambda f: against(f["n_letters"] < 0.88 * f["word_chars"]),
        "some_repeats": lambda f: against(f["n_repeat_words"] > 0.02 * f["n_words"]),
        "some_lines": lambda f: against(f["n_dup_lines"] > 0),
        "brief": lambda f: against(f["n_words"] < 40),
    }


FAULTS = _rules()
RULES = FAULTS | _witnesses()


def votes(rows: np.ndarray) -> np.ndarray:
    """Votes of all rules, documents by rules, from rows of FEATURES."""
    f = {k: rows[:, i].astype(np.float64) for i, k in enumerate(FEATURES)}
    return np.stack([r(f) for r in RULES.values()], axis=1).astype(np.int8) if len(rows) else np.zeros((0, len(RULES)), np.int8)


def encode(v: np.ndarray) -> np.ndarray:
    """A vote pattern as a number in base three."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def decode(code: np.ndarray, rules: int) -> np.ndarray:
    return ((np.asarray(code, np.int64)[:, None] // 3 ** np.arange(rules, dtype=np.int64)) % 3 - 1).astype(np.int8)


@dataclass(frozen=True)
class LabelModel:
    """Of each kind of fault the prior of texts without it, and for each rule the rates of its votes (bad, abstain, good) on texts with and without it: kinds by rules by 2 by 3. own: the kind's rule, -1 for all rules."""

    priors: np.ndarray
    rates: np.ndarray
    own: tuple[int, ...]

    @property
    def prior(self) -> float:
        """Of quality."""
        return float(self.priors.prod())

    @property
    def accuracy(self) -> np.ndarray:
        """Share of each rule's votes, abstentions left out, that are right of its kind of fault."""
        rules = np.arange(max(len(self.own), 1) if self.own != (-1,) else self.rates.shape[1])
        kind = 0 * rules if self.own == (-1,) else rules
        bad, good = (1 - self.priors[kind])[:, None] * self.rates[kind, rules, 0], self.priors[kind][:, None] * self.rates[kind, rules, 1]
        return (bad[:, 0] + good[:, 2]) / (bad[:, 0] + bad[:, 2] + good[:, 0] + good[:, 2])

    def without(self, v: np.ndarray) -> np.ndarray:
        """Posterior probability that a fault is absent, patterns by kinds. It counts as absent where its own rule doesn't vote bad."""
        out = np.ones((len(v), len(self.own)))
        for k, own in enumerate(self.own):
            odds = np.log(np.maximum(self.rates[k, :, 1], 1e-12) / np.maximum(self.rates[k, :, 0], 1e-12))
            total = np.log(self.priors[k] / (1 - self.priors[k])) + odds[np.arange(v.shape[1]), v.astype(np.int64) + 1].sum(1)
            p = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
            out[:, k] = p if own < 0 else np.where(v[:, own] == -1, p, 1)
        return out

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Of quality: no fault."""
        return self.without(v).prod(1)


#: Pseudo-counts of votes (bad, good): a bad vote is rare on good texts, so it weighs more than a good one.
SEEN_BAD, SEEN_GOOD = np.array([4.0, 3.0]), np.array([0.1, 6.9])
#: Prior that a rule seldom errs about its own fault: so many right votes are added for each vote seen.
SELDOM = 1.0


def fit_label_model(v: np.ndarray, counts: np.ndarray, rounds: int = 50, false_alarm: float | None = None, faults: int | None = None) -> LabelModel:
    """Expectation-maximisation over vote patterns, from the guess that a text has the faults that rules find.

    Each of the first ``faults`` rules (all, if None) has a kind of fault of its own, so faults needn't meet in a text, and a common one doesn't
    outweigh a rare one. Where a rule's bad votes mostly come with those of others, one alone is taken for
    an error; how often that happens is estimated without a bound. With ``false_alarm``, a bound of that rate,
    all rules are taken to look for one fault instead.

    The pseudo-counts keep texts with and without a fault apart, so a corpus of one class is not split in two.
    """
    kinds = range(v.shape[1] if faults is None else faults) if false_alarm is None else (-1,)
    fits = [_fit_kind(v, counts, own, rounds, false_alarm) for own in kinds]
    return LabelModel(np.array([m.priors[0] for m in fits]), np.concatenate([m.rates for m in fits]), tuple(kinds))


def _fit_kind(v: np.ndarray, counts: np.ndarray, own: int, rounds: int, false_alarm: float | None) -> LabelModel:
    counts = np.where(v[:, own] == 0, 0, counts) if own >= 0 else counts  # a rule tells nothing of its fault where it abstains
    n, rules = float(counts.sum()), v.shape[1]
    cast = np.stack([(v == k) for k in (-1, 0, 1)], axis=2).astype(np.float64)  # patterns by rules by votes
    silent = np.clip(np.einsum("i,ij->j", counts, cast[:, :, 1]) / max(n, 1), 0, 1 - 1e-6)[:, None]  # abstaining says nothing of the class
    mine = np.full(rules, own < 0) | (np.arange(rules) == own)
    p, model = np.where((v[:, mine] == -1).any(1), 0.1, 0.95), LabelModel(np.array([0.8]), np.full((1, rules, 2, 3), 1 / 3), (own,))
    if own >= 0:
        p = np.where(v[:, own] == -1, p, 1)
    on_bad = np.where(mine[:, None], SEEN_BAD, SEEN_GOOD)
    for _ in range(rounds):
        bad, good = (np.einsum("i,ijk->jk", q * counts, cast)[:, ::2] for q in (1 - p, p))
        right_bad, right_good = (np.where(mine & (own >= 0), SELDOM * x.sum(1), 0) for x in (bad, good))
        alarms = (good[:, 0] + SEEN_GOOD[0]) / (good.sum(1) + SEEN_GOOD.sum() + right_good)
        hits = ((bad + on_bad)[:, 0] + right_bad) / ((bad + on_bad).sum(1) + right_bad)
        fault = np.stack([hits, alarms if false_alarm is None else np.minimum(alarms, false_alarm)], axis=1)
        rates = np.stack([fault * (1 - silent), np.broadcast_to(silent, fault.shape), (1 - fault) * (1 - silent)], axis=2)
        share = ((p * counts).sum() + 8) / (n + 10) if own < 0 else ((p * counts).sum() + 8) / (n + 8 + 2 / rules)
        prior = np.clip(share, 0.5, 0.98) if own < 0 else share
        done = np.abs(rates - model.rates[0]).max(initial=0) < 1e-9
        model = LabelModel(np.array([prior]), rates[None], (own,))
        p = model.without(v)[:, 0]
        if done:
            break
    return model


def _rows(column: pa.Array) -> np.ndarray:
    return np.array([features(x) for x in texts(column)], np.int64).reshape(-1, len(FEATURES))


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, FEATURES and the vote pattern of every document."""

    def run(batches):
        for b in batches:
            rows = _rows(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(FEATURES))), pa.array(encode(votes(rows)))], names=["id", *FEATURES, "votes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col)), run, f"id {kind}, {', '.join(f'{c} bigint' for c in FEATURES)}, votes bigint")


def fit_on_patterns(patterns: DataFrame) -> LabelModel:
    """patterns: a column ``votes``. The distinct patterns reach the driver, at most 3 ** 9 * 2 ** 4."""
    got = patterns.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_label_model(decode(np.array([r.votes for r in got], np.int64), len(RULES)), np.array([r.n for r in got], np.float64), faults=len(FAULTS))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features of every document with ``quality`` (posterior), ``base_failed`` and ``kept``.

    One pass over the texts: the counts go to a scratch table, the model is fitted to its vote patterns.
    """
    spark, table = docs.sparkSession, materialize(quality_features(docs, id_col, text_col), "quality")
    codes = [r.votes for r in table.select("votes").distinct().collect()]
    model = fit_on_patterns(table)
    posterior = model.posterior(decode(np.array(codes, np.int64), len(RULES)))
    lookup = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, posterior, strict=True)], "votes bigint, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        table.join(F.broadcast(lookup), "votes", "left")  # one row a pattern: 3 ** 9 * 2 ** 4 at most, 5 MB
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
        .withColumnRenamed("id", id_col)
    )


def filter_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents kept, with all their columns. Two passes over the texts, no shuffle of them."""
    at = docs.columns.index(text_col)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encode(votes(_rows(b.column(0)))))], names=["votes"])

    model = fit_on_patterns(map_batches(docs.select(text_col), count, "votes bigint"))

    def keep(batches):
        for b in batches:
            rows = _rows(b.column(at))
            failed = (rows[:, 0] < 10) | (100 * rows[:, 4] > 20 * rows[:, 0])
            yield b.filter(pa.array(~failed & (model.posterior(votes(rows)) >= threshold)))

    return map_batches(docs, keep, docs.schema)
