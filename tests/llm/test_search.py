"""Lexical search, collocations and BPE against plain versions, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from causeway.llm import bpe, collocations, lexical

WIDE = "doc_id bigint, text string, lang string, row string, n string, found string, term string, unit string, phrase string, ids string, key string, item string"
EXTRA = tuple("abcdefghi")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
STRANGE = ["", None, " ", "\n", "...", " . , ", "Ünder  the\tBridge", "it's we'll  'S  x\n\n y", "a\x00b\x1cc", "<|endoftext|> x<|endoftext|>", "<|endof", "  lead", "trail  ", "　wide space", "१२३ ٤٥", "éa", "\U0001f600\U0001f469‍\U0001f680", "࢏\U00011db0 new", "ab" * 3000, "\x85\xa0 ", "DON'T don't", "1234567 3.14", "end.of.word,new:piece;x"]


def rows(n=120, seed=3):
    rng = random.Random(seed)
    words = [rng.choice("abcdefgh") * rng.randint(1, 2) + rng.choice("xyz") for _ in range(30)] + ["The", "of", "and"]
    out = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ". ", "\n"]) for _ in range(rng.randint(1, 80))), rng.choice(["en", "de", None])) for i in range(n)]
    out += [(500 + i, t, "en") for i, t in enumerate(STRANGE)] + [out[3], out[3], (None, "the of and", "en"), (700, out[5][1], out[5][2]), (701, "same old words " * 5000, "de")]
    return [(*r, *EXTRA) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), WIDE).repartition(3)


def plain_search(documents, items, k):
    found = [(d, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for d, t, *_ in documents]
    found = [(d, c, c.total()) for d, c in found if c]
    n_docs, words = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        asked = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        scored = []
        for d, c, n in found:
            m = 50 + (50 * n * n_docs) // words
            scored.append((-sum(lexical.weight(n_docs, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked & c.keys()), d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "shard", "block"), [(5, 16, 10_000), (50, 16_384, 10_000), (500, 40, 3)])
def test_search_equals_plain_scores(spark, docs, k, shard, block):
    items = [(1, "The ax, ax OF bx"), (2, None), (3, ""), (4, "nowhere"), (5, rows()[5][1]), (6, "same old"), (6, "same old"), (7, "x १२३")]
    table = spark.createDataFrame(items, "item_id int, text string")
    got = lexical.search(docs, table, k, shard=shard, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows(), items, k)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "the")], "item_id int, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs.filter("text = ''"), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_processing_stops_early_and_stays_exact():
    """Rare terms decide: groups of a frequent one that can't lift a new document are left out."""
    rng = np.random.default_rng(1)
    n = 5000
    term = np.concatenate([np.zeros(n, np.int64), np.ones(40, np.int64)])
    row = np.concatenate([np.arange(n), rng.choice(n, 40, replace=False)])
    impact = np.concatenate([rng.integers(1000, 400_000, n), rng.integers(300_000, 400_000, 40)])
    s = lexical.Shard(term, impact, np.ones(len(term), np.int64), row)
    query = {0: 100, 1: 9000}
    docs, scores, processed = s.best(query, 10)
    whole = Counter()
    for t, r, i in zip(term, row, impact, strict=True):
        whole[int(r)] += int(query[int(t)] * i)
    assert processed < len(term) / 2
    assert sorted(scores.tolist(), reverse=True)[:10] == sorted(whole.values(), reverse=True)[:10]
    assert all(whole[int(s.rows[d])] == x for d, x in zip(docs, scores, strict=True))


def plain_collocations(documents, least, longest, covered, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in documents:
        for piece in re.findall(r"[^.,;:!?\x0A-\x0D]+", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = {(g, w[i : i + k]) for (g, w), a in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= covered * f[g, w[i : i + k]]}
    out = []
    for (g, w), a in often.items():
        if (g, w) not in inside:
            s, k = min(((10**6 * a * a) // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
            out.append((g, -s, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
    ranks, rows_ = Counter(), []
    for g, s, a, p, left, right in sorted(out):
        ranks[g] += 1
        if ranks[g] <= top:
            rows_.append((g, ranks[g], p.decode(), -a, left, right, n[g], -s))
    return rows_


@pytest.mark.parametrize(("least", "longest", "covered", "unit"), [(10, 3, 50, 6 << 20), (3, 3, 50, 300), (2, 4, 80, 100), (300, 3, 50, 20_000)])
def test_collocations_equal_plain_counts(docs, least, longest, covered, unit):
    got = collocations.collocations(docs, least, longest, covered, 40, unit=unit)
    want = plain_collocations(rows(), least, longest, covered, 40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and want
    assert sorted(map(tuple, got.collect())) == want


def test_counts_do_not_depend_on_the_size_of_automata_or_sketch():
    text = collocations.laid_out(("a b a b c. " * 50 + "a a a a, b").encode())
    cells = np.unique(np.concatenate([c for *_, c, _ in collocations.Unit(text).phrases(3, "en", 20)]))
    one = dict(zip(*collocations.scan(text, "en", cells, 3, 20), strict=True))
    assert one == dict(zip(*collocations.scan(text, "en", cells, 3, 20, keys=1), strict=True))
    assert one[b"c"] == 50 and one[b"a a"] == 3 and one[b"a a a"] == 2 and one[b"a b"] == 100 and one[b"b a"] == 50 and b"c a" not in one
    assert collocations.laid_out(b" ") == b" \n " and collocations.laid_out(b"A.b") == b" a \n b \n "


def test_collocations_of_empty_tables(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.filter("text = ''")).count() == 0


def tokenizer():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.mark.parametrize(("chunk", "bucket"), [(bpe.CHUNK, bpe.BUCKET), (200, 700)])
def test_bpe_equals_the_tokenizer(docs, chunk, bucket):
    t, plain = tokenizer(), Counter()
    for d, text, *_ in rows():
        plain[d, tuple(t.encode(text or "", add_special_tokens=False).ids)] += 1
    encoded = bpe.encode(docs, chunk=chunk, bucket=bucket)
    assert encoded.columns == ["doc_id", "ids"]
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == plain
    back = Counter((r.doc_id, r.text) for r in bpe.decode(encoded).collect())
    assert back == Counter((d, t.decode(list(ids), skip_special_tokens=False)) for (d, ids), k in plain.items() for _ in range(k))
    bpe.forget(encoded)


def test_words_are_cut_as_the_tokenizer_cuts_them():
    w, rng = bpe.words_at(bpe.default_tokenizer()), random.Random(4)
    pool = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), *range(0x300, 0x560), *range(0x3000, 0x3100), *range(0x88F, 0x8A0), *range(0x11DB0, 0x11DF2))] + ["'s", "'ll", "  ", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(1, 12)))
        assert [i for x in w.encode(list(w.cut(text))) for i in x] == w.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for top in (1, 150, 256, 17_000, 1 << 20, 1 << 32):
        columns = [rng.integers(0, top, n) for n in (0, 1, 500)] + [np.array([0, 191, 192, 255, 16_319, 16_320, 16_321, (1 << 32) - 1])]
        got, tail = bpe._unsqueeze(bpe._squeeze(*columns, tail=b"rest"))
        assert tail == b"rest" and all(np.array_equal(a, b) for a, b in zip(got, columns, strict=True))


def test_any_ids_decode(spark):
    t, rng = tokenizer(), random.Random(5)
    lists = [[rng.randrange(50_257) for _ in range(rng.randint(0, 40))] for _ in range(200)] + [[], None, [50_256], [7] * 25_000]
    table = spark.createDataFrame([(i, "x", x) for i, x in enumerate(lists)], "doc_id int, piece string, ids array<int>").repartition(2)
    got = {r.doc_id: r.text for r in bpe.decode(table).collect()}
    assert got == {i: t.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}
    assert [r.text for r in bpe.decode(spark.createDataFrame([(1, [10**6, None, 64])], "doc_id int, ids array<int>")).collect()] == ["a"]
    assert bpe.decode(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="text"):
        bpe.decode(table.withColumn("text", F.lit("")))


def test_bpe_of_empty_tables_and_unfit_tokenizers(docs):
    import public_tokenizers

    assert bpe.encode(docs.limit(0)).count() == 0
    assert [r.ids for r in bpe.encode(docs.filter("text = ''")).collect()] == [[]]
    with pytest.raises(ValueError, match="byte-level"):
        bpe.encode(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
