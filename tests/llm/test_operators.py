"""Operators against brute force on small tables, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from causeway.llm import automaton, html, langid, lm, mixing, packing, pq, quality, secrets, simhash, toxicity
from causeway.llm.common import held_out, learnable
from causeway.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, fingerprint string, score string, h string"
CLASH = ("a", "b", "c", "d", "e")


def corpus(n=40, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "the", "of", "and", "ünder", "maß"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(1, 60)))
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 4}", len(text), *CLASH))
    rows += [(100, None, None, None, None, *CLASH), (101, "", "en", None, 0, *CLASH), (102, " \n\t ", "en", "s1", 4, *CLASH), (None, "no id here", "en", "s0", 10, *CLASH)]
    rows += [rows[3], rows[3], (103, rows[5][1], "en", "s0", 5, *CLASH), (104, "long " * 4000, "en", "s2", 20000, *CLASH), (105, "x" * 30000, None, "s2", 30000, *CLASH), (106, "a\x1cb c \x0b d", "en", "s3", 9, *CLASH)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# 1 and 2


def test_toxicity_learns_and_holds_up(spark):
    rng = random.Random(4)
    plain = ["river", "stone", "window", "garden", "table", "morning", "paper", "letter", "winter", "bridge"]
    bad = ["grobulous", "snarkwit", "flimfoozle"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = " ".join(rng.choices(plain, k=60))
        if toxic:
            text += " " + " ".join(rng.choices(bad, k=4))
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1000, None)]
    d, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(d, lab.filter(learnable("doc_id", 3)))
    got = {}
    for r in toxicity.score(d, model).collect():
        got.setdefault(r.doc_id, r)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].predicted == int(i % 4 == 0) for i in held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].predicted == 0 and got[1001].score < 0.7
    assert toxicity.fit(d, lab.limit(0)) is None
    assert {r.score for r in toxicity.score(d, None).collect()} == {0.0}


def test_language_codes_and_prediction(spark, docs, nothing):
    code = langid.codewords(4)
    distance = [(code[a] != code[b]).sum() for a in range(4) for b in range(a)]
    assert code.shape == (4, 7) and min(distance) == 4
    assert len(np.unique(langid.codewords(12), axis=0)) == 12
    texts = {"en": "the house and the garden are where they live", "fr": "la maison et le jardin où ils habitent toujours", "fi": "talo ja puutarha jossa he asuvat aina yhdessä"}
    rows = [(i, " ".join(random.Random(i).sample(t.split(), 6)), k) for k, t in texts.items() for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(d.filter("doc_id % 3 <> 1").selectExpr("lang", "doc_id AS key", "text"))
    wrong = langid.predict(d, model).join(d, "doc_id").count()
    assert wrong == 3 * 3 * 60
    got = {(r.text): r.lang_pred for r in langid.predict(d.withColumnRenamed("doc_id", "i").withColumnRenamed("text", "doc_id").selectExpr("doc_id", "doc_id AS text"), model).selectExpr("doc_id AS text", "lang_pred").collect()}
    assert all(got[t] == k for _, t, k in rows)
    plain = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert plain[100].lang_pred == plain[101].lang_pred == "und" and plain[100].score == 0
    assert langid.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in langid.predict(d, None).collect()} == {"und"}


# 3


def test_region_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.choice([-3, -1, -0.5, 1, 2]) for _ in range(rng.randint(0, 12))]
        best = max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        i, j = html.region(s)
        assert sum(s[i:j]) == best


def test_main_text(spark):
    w = html.learn(html.labelled_pages())
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home page</a></li></ul></nav>"
        "<!-- ad --><div class=\"ad\">Buy this now today</div><article><h1>Big news &amp; more</h1><p><b>First</b>ly&nbsp;text\n here.<br><p>Second block of words<aside>See also these things</aside></p>"
        "<div class='comments'><p>nice one I liked this</p></div></article><form><input name=q>Search this site</form><footer>&copy; us</footer></body></html>"
    )
    assert html.main_text(page, w) == "Big news & more Firstly text here. Second block of words"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>cut <b>off here in the mid"), (5, "x", "<nav>only a menu</nav>")]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 6 and text[2] == text[3] == text[5] == "" and text[4] == "cut off here in the mid"
    assert all(r.n_chars == len(r.text) for r in got)


# 4


def brute_fingerprint(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    text = {r[0]: r[1] for r in corpus()}
    assert len(got) == len(corpus())
    assert all(int(r.fingerprint, 16) == brute_fingerprint(text[r.doc_id]) for r in got)
    f = [int(r.fingerprint, 16) for r in got]
    label = union(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    least = {k: min((got[i].doc_id for i in range(len(f)) if label[i] == k and got[i].doc_id is not None), default=None) for k in set(label)}
    assert all(r.component_id == least[k] for r, k in zip(got, label, strict=True))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0


@pytest.mark.parametrize("n, shard", [(3000, 1024), (1200, 40), (1500, 4)])
def test_links_keep_components_of_dense_groups(spark, n, shard):
    rng = random.Random(n)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(n // 2)}
    while len(fps) < n:
        x = centre
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    f = np.array(sorted(fps), np.uint64)
    pairs = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 4) if j < i]
    signed = f.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = [(r.a, r.b) for r in simhash.links(df, len(signed), 4, shard).collect()]
    at = {x: i for i, x in enumerate(signed)}
    assert all((int(f[at[a]]) ^ int(f[at[b]])).bit_count() <= 64 for a, b in edges)
    assert union(len(f), [(at[a], at[b]) for a, b in edges]) == union(len(f), pairs)


def test_near_fingerprints_meet_in_a_shard():
    rng = random.Random(0)
    for levels in (1, 3, 8):
        for _ in range(150):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            cells, who, used = simhash.route(np.array([x, y], np.uint64), levels, 2)
            homes = {int(f): set(cells[(who == f) & (used == 0)].tolist()) for f in who.tolist()}
            assert any(homes[a] & set(cells[who == b].tolist()) for a, b in ((x, y), (y, x)))


def test_trees_split_and_prune():
    rng = np.random.default_rng(1)
    f = np.unique(rng.integers(0, 1 << 63, 100_000).astype(np.uint64) << np.uint64(1))
    cells, who, used = simhash.route(f, simhash.shard_levels(len(f), simhash.SHARD), 2)
    order = np.argsort(cells, kind="stable")
    cells, who, used = cells[order], who[order], used[order]
    cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
    compared = 0
    for i, j in zip(cuts, cuts[1:], strict=False):
        home = used[i:j] == 0
        if home.any():
            compared += simhash.Search(who[i:j][home], who[i:j][~home], used[i:j][~home], int(cells[i]) >> 24, 3, 4).compared
    assert len(cuts) > 200 and compared < 0.1 * len(f) ** 2 / 2


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = union(500, edges)
    assert all(got.get(i, i) == label[i] for i in range(500))
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 5


def test_language_model(docs, nothing):
    d = docs.filter("doc_id is not null")
    got = lm.score(d, learnable("doc_id", 5), chunk=300, shard=500).withColumn("held", held_out("doc_id", 5)).collect()
    tokens = lambda t: [*(t or "").encode().translate(lm.LOWER).split(), b" "]
    rows = [r for r in corpus() if r[0] is not None]
    train = [w for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1 for w in tokens(r[1])]
    c, n = Counter(train), len(train)
    want = {r[0]: sum(np.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in tokens(r[1])) for r in rows}
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.n_tokens == len(tokens(text[r.doc_id])) and r.train_tokens == n and abs(r.base_score - want[r.doc_id]) < 1e-6
        assert r.n_known == sum(c[w] > 0 for w in tokens(text[r.doc_id])) and r.score < 0
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    whole = {r.doc_id: r.score for r in lm.score(d, learnable("doc_id", 5)).collect()}
    assert sum(whole.values()) == pytest.approx(sum({r.doc_id: r.score for r in got}.values()), rel=0.02)
    assert lm.score(nothing, learnable("doc_id", 5)).count() == 0


def test_seating_follows_the_exact_distribution():
    rng, d, n, weight = np.random.default_rng(1), 0.6, 5, 0.8
    s = {(0, 0): 1.0}
    for i in range(n):
        for t in range(i + 2):
            s[i + 1, t] = s.get((i, t - 1), 0) + (i - d * t) * s.get((i, t), 0)
    p = np.array([s[n, t] * weight**t for t in range(1, n + 1)])
    got = np.bincount(lm.seat(np.full(40_000, n), np.full(40_000, weight), d, rng).astype(int), minlength=n + 1)[1:] / 40_000
    assert np.abs(got - p / p.sum()).max() < 0.015
    assert 1 <= lm.seat(np.array([10_000]), np.array([0.5]), d, rng)[0] <= 10_000


# 6


def brute_repeats(words):
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def test_quality_counts_and_model(docs, nothing):
    got = quality.score_quality(docs).collect()
    text = {r[0]: r[1] or "" for r in corpus()}
    for r in got:
        b = text[r.doc_id].encode()
        words, lines = WORD.findall(b), [x for x in b.split(b"\n") if WORD.search(x)]
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == brute_repeats(words)
        assert r.base_failed == (len(words) < 10 or 100 * brute_repeats(words) > 20 * len(words)) and not (r.kept and r.base_failed)
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.score_quality(nothing).count() == 0 and quality.filter_quality(nothing).count() == 0
    rng = random.Random(6)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 30))]
        assert quality.repeat_words(words) == brute_repeats(words)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(5)
    truth, accuracy = rng.random(20_000) < 0.8, np.array([0.95, 0.7, 0.9, 0.8])
    v = np.where(rng.random((20_000, 4)) < accuracy, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    v[rng.random(v.shape) < 0.3] = 0
    m = quality.fit_label_model(v.astype(np.int8), np.ones(len(v)), false_alarm=1.0)
    assert np.abs(m.accuracy - accuracy).max() < 0.03 and abs(m.prior - 0.8) < 0.02
    assert (quality.decode(quality.encode(v), 4) == v).all()


# 7


def test_packing_round_trip(docs, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    assert packing.piece_lengths(4096 + 2048 + 37) == [2048] * 3 + [32, 4, 1] and packing.piece_lengths(1) == [1]
    rows = packing.pack(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    text, copies = {r[0]: r[1] for r in corpus()}, Counter(r[0] for r in corpus())
    for i, n in copies.items():
        ids = [*t.encode(text[i] or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == n * len(ids)
        for r in mine:
            assert list(struct.unpack(f"<{r.length}I", r.ids)) == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids)
    assert packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, longest=1000)


def test_word_ids_equal_the_tokenizers():
    w = packing.WordTokenizer(packing.default_tokenizer(), remembered=50)
    rng = random.Random(3)
    parts = ["a", "B", "É", "'s", "'T", "'re", "1", "²", "½", "ª", "ß", "İ", "Σ", "é", "́", " ", " ", "\x1c", "\n", "<|endoftext|>", "<|", "?!", "€", "中", "ll", "×", "ŉ"]
    for _ in range(3000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        a = w.ids(x.encode())
        assert list(struct.unpack(f"<{len(a) // 4}I", a)) == w.tokenizer.encode(x, add_special_tokens=False).ids


# 8

BASE = (
    (re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), lambda m: len(m[2]) >= 6),
    (re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def test_scanner_agrees_with_regular_expressions():
    s, rng = secrets.Scanner(), random.Random(1)
    parts = [b"password", b"PassWd", b"secret", b"token", b"api_key", b"APIkey", b'"', b" ", b":", b"=", b"=", b"abc", b"AKIA", b"A0", b"deadbeef", b"0123456789abcdef", b"\n", b"-", b"ABCDEFGHIJKLMNOP", b"K", b"\xc3\xa9"]
    for _ in range(5000):
        x = b"".join(rng.choices(parts, k=rng.randint(1, 14)))
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in p.finditer(x) if ok(m))
        assert [y for y in s.scan(x) if y[1] < 3] == want
    assert s.all.states < 3000  # whole rules, not their openings


@pytest.mark.parametrize("pattern", ["a(b|cd)*e{2,3}", "[^a-c]x+|y?z", "(ab|a)(c|bcd)", "\\x41[b-d]{2}"])
def test_automaton_agrees_with_re(pattern):
    d, r, rng = automaton.compile_dfa([automaton.parse(pattern)], search=False), re.compile(pattern), random.Random(pattern)
    for _ in range(3000):
        x = "".join(rng.choices("abcdexyzA", k=rng.randint(0, 8)))
        state = d.start
        for b in x.encode():
            state = d.table[state + b]
        assert (state >= d.first_accept) == bool(r.fullmatch(x))


def test_secrets_of_documents(spark, docs, nothing):
    rows = [(1, "é password: hunter22 x"), (1, "é password: hunter22 x"), (2, None), (3, ""), (4, "ghp_" + "a1B2" * 9), (5, "token=abc")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.found] for r in secrets.find_secrets(d).collect()}
    assert got == {1: [("assign", 2, 20)], 2: [], 3: [], 4: [("hub", 0, 40)], 5: []}
    assert {r.doc_id: r.text for r in secrets.redact_secrets(d).collect()} == {1: "é [assign] x", 2: None, 3: "", 4: "[hub]", 5: "token=abc"}
    assert secrets.redact_secrets(docs).columns == docs.columns and secrets.find_secrets(nothing).count() == 0


# 9


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[0] + rng.normal(size=(40, 16)) * 0.08
    x[140:170] = x[1]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, []), (505, [1.0, 2.0]), (None, x[5].astype(np.float32).tolist()), (7, x[7].astype(np.float32).tolist())]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = pq.near_vectors(d, tile=32).collect()
    v = np.array([r[1] for r in rows[:300]] + [rows[-2][1], rows[-1][1]], np.float64)
    ids = [*range(300), None, 7]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    label = union(len(v), [(i, j) for i in range(len(v)) for j in range(i) if near[i, j]])
    by = {}
    for r in got:
        by.setdefault(r.vec_id, r)
    for i, k in zip(ids, label, strict=True):
        assert by[i].n_links == near[ids.index(i)].sum() - 1
        assert by[i].component_id == min(ids[j] for j in range(len(v)) if label[j] == k and ids[j] is not None)
    for i in (500, 501, 502, 503, 504, 505):
        assert by[i].n_links == 0 and by[i].component_id == i and by[i].kept
    assert not by[None].kept and len(got) == len(rows)
    assert pq.near_vectors(d.limit(0)).count() == 0


def test_recall_of_near_pairs(spark):
    """Of random vectors and copies at cosines around the threshold, nine in ten links at least are found; none that isn't."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.concatenate([base, base[:1500] + rng.normal(size=(1500, 32)) * rng.uniform(0.01, 0.06, size=(1500, 1))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    d = spark.createDataFrame([(i, v.tolist(), "x", "y") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, node string, lists string")
    got = np.array([r.n_links for r in sorted(pq.near_vectors(d).collect(), key=lambda r: r.vec_id)])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() and want.sum() > 1500


def test_a_cosine_equal_to_the_threshold_links(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, -1.0])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.n_links, r.component_id) for r in sorted(pq.near_vectors(d, threshold=0.6).collect())] == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


# 10


def test_mix_meets_targets(docs, nothing):
    m = mixing.mix(docs, block=8)
    got = m.taken(["doc_id"]).collect()
    sources = {r.sid: r for r in m.sources.collect()}
    assert len(got) == len(corpus())
    size = {r[0]: len(WORD.findall((r[1] or "").encode())) for r in corpus()}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in got)
    for sid, s in sources.items():
        assert abs(sum(r.taken for r in got if r.sid == sid) - s.target) <= 16 and s.target <= 2 * s.source_size + 1e-9
    assert sum(s.target for s in sources.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    names = [s.source for s in sorted(sources.values(), key=lambda s: s.sid)]
    assert names == [*sorted(x for x in names if x is not None), None]
    again = mixing.mix(docs.repartition(7), block=8).taken(["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
    slots = m.schedule.collect()
    assert len({s.position for s in slots}) == len(slots) == sum(s.slots for s in sources.values())
    assert all(s["pass"] < 3 for s in slots)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.filter("trim(coalesce(text, '')) = ''").count() == 0
    assert mixing.mix(nothing).taken(["doc_id"]).count() == 0 and mixing.mix_documents(nothing).count() == 0
