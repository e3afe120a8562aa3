"""Whole results of queries beyond SQL against plain loops over the same documents."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from causeway.llm import mixing, packing, quality, secrets
from causeway.llm.common import materialize
from conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The rules as patterns of ``re``: kind, pattern, least bytes.
PATTERNS = [
    ("assign", re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), 0),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(rb"[0-9a-f]{24,}"), 0),
    ("pem", re.compile(rb"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"), 0),
    ("hub", re.compile(rb"gh[pousr]_[A-Za-z0-9]+"), 40),
    ("chat", re.compile(rb"xox[abprs]-[A-Za-z0-9-]+"), 24),
    ("jwt", re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 40),
    ("url", re.compile(rb"[a-z]+://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%-]+@"), 12),
]


def brute_spans(data):
    """(start, rule, end) in bytes."""
    out = []
    for k, (kind, pattern, least) in enumerate(PATTERNS):
        for m in pattern.finditer(data):
            if len(m[0]) >= least and (kind != "assign" or len(m[2]) >= 6):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def brute_redaction(data):
    out, last = b"", 0
    for start, k, end in brute_spans(data):
        if start >= last:
            out += data[last:start] + b"[" + PATTERNS[k][0].encode() + b"]"
        last = max(last, end)
    return out + data[last:]


def brute_posteriors(rows):
    """Of quality, text by text: the label model fitted by loops over texts, one kind of fault after another."""
    rules, kinds = len(quality.RULES), len(quality.FAULTS)
    total = [1.0] * len(rows)
    for k in range(kinds):
        some = [i for i, v in enumerate(rows) if v[k]]
        n = len(some)
        silent = [min(sum(not rows[i][j] for i in some) / max(n, 1), 1 - 1e-6) for j in range(rules)]
        p = {i: 0.1 if rows[i][k] < 0 else 1.0 for i in some}
        old = [[1 / 3] * 6] * rules
        for _ in range(50):
            rates = []
            for j in range(rules):
                sums = {(side, vote): sum((q if side else 1 - q) for i, q in p.items() if rows[i][j] == vote) for side in (0, 1) for vote in (-1, 1)}
                seen = quality.SEEN_BAD if j == k else quality.SEEN_GOOD
                more = [quality.SELDOM * (sums[s, -1] + sums[s, 1]) if j == k else 0 for s in (0, 1)]
                hit = (sums[0, -1] + seen[0] + more[0]) / (sums[0, -1] + sums[0, 1] + sum(seen) + more[0])
                alarm = (sums[1, -1] + quality.SEEN_GOOD[0]) / (sums[1, -1] + sums[1, 1] + sum(quality.SEEN_GOOD) + more[1])
                rates.append([x for f in (hit, alarm) for x in (f * (1 - silent[j]), silent[j], (1 - f) * (1 - silent[j]))])
            prior = (sum(p.values()) + 8) / (n + 8 + 2 / rules)
            done = max(abs(a - b) for x, y in zip(rates, old, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9
            old = rates

            def absent(v):
                odds = math.log(prior / (1 - prior)) + sum(math.log(max(rates[j][3 + v[j] + 1], 1e-12) / max(rates[j][v[j] + 1], 1e-12)) for j in range(rules))
                return 1 / (1 + math.exp(-min(max(odds, -50), 50)))

            p = {i: absent(rows[i]) if rows[i][k] < 0 else 1.0 for i in some}
            if done:
                break
        for i in some:
            total[i] *= p[i]
    return total


def brute_fingerprint(text):
    words = [w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for w in WORD.findall(text)]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_spans_of_all_rules_equal_the_patterns(spark, documents):
    rng = random.Random(8)
    parts = ["-----BEGIN ", "RSA ", "EC ", "PRIVATE KEY-----", "ghp_", "gho_", "xoxb-", "xoxp-", "eyJ", ".eyJ", ".", "http", "://", "user", ":", "pa%20s", "@", "é", " ", "\n", "a1b2c3", "AKIA", "Q" * 18, "x" * 37, "-", "_", "token=", "0f" * 12]
    rows = [(10_000_000 + i, "".join(rng.choices(parts, k=rng.randint(1, 40)))) for i in range(3_000)]
    both = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    text = {r.doc_id: (r.text or "").encode() for r in both.collect()}
    kinds = Counter()
    for r in secrets.find_secrets(both).collect():
        want = [(PATTERNS[k][0], len(text[r.doc_id][:a].decode()), len(text[r.doc_id][:b].decode())) for a, k, b in brute_spans(text[r.doc_id])]
        assert [(x.kind, x.start, x.end) for x in r.found] == want
        kinds.update(k for k, _, _ in want)
    assert len(kinds) == len(PATTERNS), kinds


def test_verdicts_equal_a_fit_text_by_text(documents):
    got = quality.score_quality(documents).collect()
    want = brute_posteriors([tuple(map(int, v)) for v in quality.decode([r.votes for r in got], len(quality.RULES))])
    assert all(abs(r.quality - p) < 1e-6 for r, p in zip(got, want, strict=True))
    assert all(r.kept == (not r.base_failed and p >= 0.5) for r, p in zip(got, want, strict=True))
    assert any(r.kept for r in got) and not all(r.kept or r.base_failed for r in got)


def test_the_pipeline_equals_plain_loops(spark, documents):
    from tokenizers import Tokenizer

    stages, rows = dict(corpus_pipeline.STAGES), {r.doc_id: r for r in documents.collect()}
    verdicts = quality.score_quality(documents).collect()
    posterior = brute_posteriors([tuple(map(int, v)) for v in quality.decode([r.votes for r in verdicts], len(quality.RULES))])
    kept = sorted(r.doc_id for r, p in zip(verdicts, posterior, strict=True) if not r.base_failed and p >= 0.5)
    prints = [brute_fingerprint(rows[i].text.encode()) for i in kept]
    first = list(range(len(kept)))

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                first[max(a, b)] = min(a, b)
    alone = [kept[i] for i in range(len(kept)) if root(i) == i]
    safe = {i: brute_redaction(rows[i].text.encode()).decode() for i in alone}

    docs = documents
    for name in ("quality", "near_duplicates", "secrets"):
        docs = materialize(stages[name](spark, docs, SF), f"whole-{name}")
    assert {r.doc_id: r.text for r in docs.collect()} == safe
    mixed = mixing.mix_documents(docs).collect()
    assert all(r.text == safe[r.doc_id] for r in mixed) and max(Counter(r.doc_id for r in mixed).values()) <= 2

    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), tuple(ids)] += 1
    got, total = corpus_pipeline.run(spark, SF).collect(), Counter()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length.bit_count() == 1 and r.length <= 2048 for r in got)
    copies = Counter()
    for (i, n, _), times in want.items():
        copies[i] += times
        total[i] += n * times
    assert total == Counter({i: sum(r.length for r in got if r.doc_id == i) for i in copies}) and {r.doc_id for r in got} == set(copies)
    for i, n, ids in {k: None for k in want}:
        for r in (r for r in got if r.doc_id == i):
            assert r.doc_tokens == n and r.ids_crc32 == crc(ids[r.start : r.start + r.length])



def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
