"""Every word is a context of its own in the language model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import lm


@pytest.fixture(scope="module")
def pairs(spark):
    """600 words, each followed by one other word wherever it stands."""
    return spark.createDataFrame([(6 * i + k, f"a{i} b{i}") for i in range(600) for k in range(6)], "doc_id bigint, text string").repartition(3)


def test_each_word_predicts_its_own_follower(pairs):
    got = lm.score(pairs, F.col("doc_id") % 6 != 1, chunk=9_000, shard=9_000).collect()
    assert len(got) == 3600 and all(r.n_known == 3 for r in got)
    # the beginning leaves 600 words, all else is sure; contexts shared by several words would leave several followers
    assert min(r.score for r in got) > np.log10(1 / 600) - 0.4


def test_probabilities_sum_to_one_in_every_context(pairs):
    words = "one two three four five six seven eight nine ten".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, 12))) for i in range(60)]
    d = pairs.sparkSession.createDataFrame(rows, "id bigint, text string").selectExpr("id", "true AS learn", "text")
    shards = 3
    book = lm.codebook(d, 4000, most=5)  # some words by rank, the others by hash
    model = lm.fit(lm._chunks(d, 1500, shards, book).filter("shard is not null"), shards)
    t, seen, parents, customers, own = model.totals, set(), {}, {}, []
    for r in model.table.collect():
        names, of, pairs_, k, roots = lm._thawed(r.data)
        for i, w in enumerate(names):
            h = int(book.codes([w])[0])
            parents[h], customers[h] = t.parent_of(k, roots)[i], pairs_["n"][of == i].sum()
        own += [(int(u), int(book.codes([names[i]])[0]), n - t.discount * s) for i, u, n, s in zip(of, pairs_["u"], pairs_["n"], pairs_["t"], strict=True)]
    tables = {}
    for r in model.tables.collect():
        t_, *codes = lm.thaw(r.data)
        h, x = lm.unpack(*codes), lm.unplanes(t_, "<f8")
        tables |= dict(zip(h.tolist(), x.tolist(), strict=True))
    assert len(parents) == len(tables) == len(words) + 1 and set(tables) == set(parents)
    unknown = t.parent_of(np.zeros(1), np.zeros(1))[0]
    for u in [*tables, 12345]:
        mine = {w: x for c, w, x in own if c == u}
        p = [t.predictive(mine.get(w, 0.0), x, customers.get(u, 0), tables.get(u, 0)) for w, x in parents.items()]
        p.append(t.predictive(0.0, unknown, customers.get(u, 0), tables.get(u, 0)))
        assert sum(p) == pytest.approx(1, abs=1e-5)
