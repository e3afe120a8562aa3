"""The pipeline on a small corpus, stage by stage."""

import corpus_pipeline
from causeway.llm import quality, secrets, simhash

WORDS = "river stone window garden table morning paper letter winter bridge candle meadow"


def test_stages(spark, tmp_path):
    import random

    rng, rows = random.Random(2), []
    for i in range(120):
        rows.append((i, " ".join(rng.choices(WORDS.split(), k=80)), "en", f"s{i % 3}", 0))
    rows += [(200, rows[0][1], "en", "s0", 0), (201, "short", "en", "s1", 0), (202, None, None, None, None), (203, rows[1][1] + " password: hunter22", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in good.collect()} == {201, 202}
    one = stages["near_duplicates"](spark, good, str(tmp_path))
    groups = {r.component_id for r in simhash.near_duplicates(good).collect()}
    assert {r.doc_id for r in one.collect()} == groups and 200 not in groups
    safe = stages["secrets"](spark, one, str(tmp_path))
    assert all(not r.found for r in secrets.find_secrets(safe).collect()) and safe.count() == one.count()
    mixed = stages["mixing"](spark, safe, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} <= groups and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    assert [f(spark, docs, str(tmp_path)).columns for f in list(stages.values())[:-1]] == [docs.columns] * 4
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() > 0 and packed.filter("length > 2048 or offset <> 0").count() == 0
    assert quality.filter_quality(docs.limit(0)).count() == 0
