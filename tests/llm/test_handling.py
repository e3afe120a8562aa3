"""Empty tables, very long texts, ties and further columns, for the operators and the stages of the pipeline."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import langid, lm, packing, quality, secrets, simhash, toxicity

WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id string, fp string, kind string, _label string, flagged string, node string, cell string, key string, words string, k string, sid string, slots string, block string"
EXTRA = tuple("abcdefghijklmn")


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(8)
    words = "river stone window garden table morning paper letter winter bridge candle meadow".split()
    rows = [(i, " ".join(rng.choices(words, k=60)) + (" grobulous snarkwit flimfoozle" if i % 4 == 0 else ""), "en", f"s{i % 3}", 0, *EXTRA) for i in range(160)]
    rows += [(500, " ".join(rng.choices(words, k=150_000)) + " grobulous snarkwit" * 2_000, "en", "s0", 0, *EXTRA), (501, None, None, None, None, *EXTRA), (502, "", "en", "s1", 0, *EXTRA), (None, "short", "en", "s1", 0, *EXTRA)]
    return spark.createDataFrame(rows, WIDE).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, toxic int")


def test_toxicity_of_long_wide_and_empty_tables(spark, wide, labels):
    model = toxicity.fit(wide, labels)
    got = {r.doc_id: r for r in toxicity.score(wide, model).collect()}
    assert len(got) == wide.count() and got[500].predicted == 1 and got[501].predicted == got[502].predicted == 0
    assert all(got[i].predicted == (i % 4 == 0) for i in range(160))
    assert toxicity.score(wide.limit(0), model).count() == 0 and toxicity.fit(wide.limit(0), labels) is None


def test_toxicity_learns_from_texts_without_segments():
    for sides in (([b"bad words here"] * 5, [b""] * 5), ([b""] * 5, [b"fine words here"] * 5), ([b""] * 3, [b""] * 3), ([b"bad words"] * 5, [b"abc", b"", b"x y"])):
        model = toxicity.Distance.train(*sides)
        windows = toxicity.Windows(model)
        assert all(0 <= model.score(windows.buckets(x)) <= 1 for x in (b"", b"bad words here", b"fine"))


def test_languages_tied_wide_and_empty(spark, wide):
    same = [(f"{k}{i}", "one two three four", k) for k in ("b", "a") for i in range(4)]
    model = langid.fit(spark.createDataFrame(same, "key string, text string, lang string"))
    d = spark.createDataFrame([(1, "one two three four", "x", "y")], "doc_id bigint, text string, lang string, weights string")
    (r,) = langid.predict(d, model).collect()
    assert r.lang_pred == "a" and r.score == pytest.approx(0.5) and r.ambiguous
    rng = random.Random(1)
    own = {k: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for k in range(300)}
    many = spark.createDataFrame([(f"{k}-{i}", " ".join(rng.choices(own[k], k=30)), f"l{k:03}") for k in range(300) for i in range(2)], "key string, text string, lang string")
    model = langid.fit(many)
    assert len(model.languages) == 300  # none is left out
    got = langid.predict(many.withColumnRenamed("key", "doc_id"), model).join(many.withColumnRenamed("key", "doc_id"), "doc_id")
    assert got.filter("lang = lang_pred").count() >= 0.9 * got.count()
    assert langid.predict(wide, model).count() == wide.count()


@pytest.mark.parametrize("unit", ["eyJ", "eyJa.eyJ", "a://b:", "a://", "password ", "password: ", "token=", "-----BEGIN A ", "AKIA", "ghp_", "xoxb-", "0a", 'secret"'])
def test_any_text_is_scanned_in_linear_time(unit):
    s = secrets.scanner()

    def seconds(n):
        x = (unit * (n // len(unit) + 1))[:n].encode()
        began = time.perf_counter()
        s.scan(x)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(1_000_000) < 3 + 30 * seconds(100_000)


def test_secrets_in_long_wide_and_empty_tables(wide):
    long_ = wide.withColumn("text", F.when(F.col("doc_id") == 500, F.concat("text", F.lit(" password: hunter22"))).otherwise(F.col("text")))
    got = {r.doc_id: len(r.found) for r in secrets.find_secrets(long_).collect()}
    assert got[500] == 1 and sum(got.values()) == 1 and secrets.redact_secrets(long_).columns == wide.columns
    assert secrets.find_secrets(wide.limit(0)).count() == 0 and secrets.redact_secrets(wide.limit(0)).count() == 0


def test_other_tokenizers_are_encoded_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, texts = Tokenizer.from_file(path), ["Hello  World, it's 12 o'clock", "é\n\n ü", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in sorted(packing.pack(d, tokenizer=path, end_id=7).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 7] for i, x in enumerate(texts)}


def seated(texts, d, d0, vocabulary, sweeps, burn, rng):
    """Averaged predictive probabilities of a two-level model, customer by customer."""
    tokens = [[*t.split(), ""] for t in texts]
    customers = [(u, w) for x in tokens for u, w in zip(["", *x[:-1]], x, strict=True)]
    tables, parent = {}, {}  # (u, w): sizes; w: sizes
    n_parent = roots = 0
    opened = {}
    base = 1 / (len(vocabulary) + 1)

    def p_parent(w):
        sizes = parent.get(w, [])
        return (sum(sizes) - d0 * len(sizes) + (1 + d0 * roots) * base) / (1 + n_parent)

    def draw(weights):
        return rng.choices(range(len(weights)), weights)[0]

    def sit(u, w):
        nonlocal n_parent, roots
        sizes = tables.setdefault((u, w), [])
        k = draw([x - d for x in sizes] + [(1 + d * opened.get(u, 0)) * p_parent(w)])
        if k < len(sizes):
            sizes[k] += 1
            return
        sizes.append(1)
        opened[u] = opened.get(u, 0) + 1
        up = parent.setdefault(w, [])
        j = draw([x - d0 for x in up] + [(1 + d0 * roots) * base])
        if j < len(up):
            up[j] += 1
        else:
            up.append(1)
            roots += 1
        n_parent += 1

    def leave(u, w):
        nonlocal n_parent, roots
        sizes = tables[u, w]
        k = draw(sizes)
        sizes[k] -= 1
        if sizes[k]:
            return
        del sizes[k]
        opened[u] -= 1
        up = parent[w]
        j = draw(up)
        up[j] -= 1
        n_parent -= 1
        if not up[j]:
            del up[j]
            roots -= 1

    for c in customers:
        sit(*c)
    counts, total = {}, np.zeros(len(tokens))
    for u, _ in customers:
        counts[u] = counts.get(u, 0) + 1
    pairs = sorted(set(customers))
    mean = dict.fromkeys(pairs, 0.0)
    for sweep in range(burn + sweeps):
        for c in customers:
            leave(*c)
            sit(*c)
        if sweep >= burn:
            for u, w in pairs:
                sizes = tables[u, w]
                mean[u, w] += (sum(sizes) - d * len(sizes) + (1 + d * opened[u]) * p_parent(w)) / (1 + counts[u]) / sweeps
    for i, x in enumerate(tokens):
        total[i] = sum(np.log10(mean[u, w]) for u, w in zip(["", *x[:-1]], x, strict=True))
    return total


def test_scores_agree_with_a_customer_by_customer_sampler(spark):
    rng = random.Random(11)
    words = "a a a a b b b c c d e f g h".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    rows = d.selectExpr("doc_id AS id", "true AS learn", "text")
    totals = lm.fit(lm._chunks(rows, 10_000, 1, lm.codebook(rows, 1000)).filter("shard is not null").select("shard", "chunk", "data"), 1).totals
    want = seated(texts, totals.discount, totals.root_discount, set(words) | {""}, 150, 30, rng)
    got = np.array([r.score for r in sorted(lm.score(d, F.lit(True), burn=30, sweeps=150).collect())])
    assert np.abs(got - want).max() < 0.06 * np.abs(want).max() and abs(got.sum() / want.sum() - 1) < 0.02


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_wide_and_long_tables(spark, wide, tmp_path, name, stage):
    docs = wide
    out = stage(spark, docs, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns
    assert out.count() > 0 and (name == "quality" or out.filter("doc_id = 500").count() > 0)  # the long text repeats itself
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_counts_of_quality_in_long_wide_and_empty_tables(wide):
    got = {r.doc_id: r for r in quality.score_quality(wide).collect()}
    assert got[500].n_words == 154_000 and len(got) == wide.count() and simhash.near_duplicates(wide).count() == wide.count()
    assert quality.score_quality(wide.limit(0)).count() == 0
