"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, collocations, html, langid, lexical, lm, mixing, packing, pq, quality, secrets, simhash, toxicity
from causeway.llm.common import held_out, learnable, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels").filter(learnable("doc_id", 3))))
    return out.select("doc_id", held_out("doc_id", 3).alias("held_out"), "score", "predicted", "flagged")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labelled = docs.filter(F.col("lang").isNotNull() & learnable("doc_id", 3)).select("lang", F.col("doc_id").alias("key"), "text")
    out = langid.predict(docs, langid.fit(labelled))
    return out.select("doc_id", held_out("doc_id", 3).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(read(spark, sf_dir, "documents"), learnable("doc_id", 5))
    return out.select("doc_id", held_out("doc_id", 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(read(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, base), F.sha2(_listed(F.filter("found", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def op9_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(read(spark, sf_dir, "documents"))
    return m.taken(["doc_id"]).join(m.sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    out = bpe.decode(encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "ids"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_html_extraction, op4_simhash, op5_pitman_yor, op6_quality_rules, op7_packing, op8_secret_scan, op9_embedding_pq, op10_mixing, op11_lexical_search, op12_collocations, op13_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_collocations": OP12_SQL}


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('10-' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, sum(source_size) OVER () AS words FROM s0),
s2 AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS cap, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM s1 WINDOW w AS (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (
  SELECT *, bool_and(2 * source_size < (1.5::DOUBLE * words - cap) / rest * weight) OVER (ORDER BY source_size / weight, sid) AS capped FROM s2),
level AS (
  SELECT (1.5::DOUBLE * max(words) - coalesce(sum(2 * source_size) FILTER (capped), 0)::DOUBLE) / sum(weight) FILTER (NOT capped) AS x FROM s3),
s4 AS (
  SELECT source, source_size, sid, least(source_size * 2.0::DOUBLE, weight * x) AS target, ceil(source_size / 128)::BIGINT AS blocks FROM s3, level),
s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM s4),
s6 AS (
  SELECT *, passes * blocks + floor((target - passes * source_size) / 128 + 0.5)::BIGINT AS slots FROM s5),
s7 AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot,
         sum(slots) OVER ()::BIGINT AS n FROM s6),
k AS (
  SELECT k, least(floor(((k % 2147483648 * 1327217885 % 2147483648)::DOUBLE + (k // 2147483648 * 1327217885 % 2147483648)::DOUBLE / 2147483648::DOUBLE) / 2147483648::DOUBLE * n)::BIGINT, n - 1) AS spot
  FROM (SELECT max(n)::BIGINT AS n FROM s7), unnest(range(n)) AS u(k)),
r AS (
  SELECT sid, slots, blocks, row_number() OVER (PARTITION BY sid ORDER BY k) - 1 AS rank
  FROM k JOIN s7 ON spot >= first_slot AND spot < first_slot + slots),
short AS (
  SELECT sid, slots, blocks, unnest(range(got, slots)) AS rank
  FROM (SELECT sid, slots, blocks, (SELECT count(*) FROM r WHERE r.sid = s7.sid) AS got FROM s7) WHERE got < slots),
u AS (
  SELECT sid, rank % blocks AS block, count(*) AS uses
  FROM (SELECT * FROM r WHERE rank < slots UNION ALL SELECT * FROM short) GROUP BY ALL),
laid AS (
  SELECT doc_id, sid, size, source_size, target, row_number() OVER () AS id,
         coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
p AS (
  SELECT *, CASE WHEN size = 0 THEN NULL ELSE unnest(CASE WHEN size = 0 THEN [0] ELSE range(start // 128, (start + size - 1) // 128 + 1) END) END AS block FROM laid)
SELECT doc_id, size, source_size, target,
       coalesce(sum((least(start + size, (p.block + 1) * 128) - greatest(start, p.block * 128)) * coalesce(uses, 0)), 0)::BIGINT AS taken
FROM p LEFT JOIN u ON p.sid = u.sid AND p.block = u.block
GROUP BY id, doc_id, size, source_size, target
"""

TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, {TERMS_SQL} AS terms FROM documents WHERE text IS NOT NULL),
own AS (SELECT id, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM own),
q AS (SELECT item_id, unnest(list_distinct({TERMS_SQL})) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (
  SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(terms) AS term FROM own) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
s AS (
  SELECT item_id, id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN own USING (id), total GROUP BY item_id, id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents),
v AS MATERIALIZED (
  SELECT lang, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3
  FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p)),
f1 AS MATERIALIZED (SELECT lang, w1, count(*)::BIGINT AS f FROM v GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*)::BIGINT AS f FROM v WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*)::BIGINT AS f FROM v WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, f, w1 || ' ' || w2 AS phrase FROM f3 UNION ALL SELECT lang, f, w2 || ' ' || w3 FROM f3) GROUP BY lang, phrase),
kept AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase)::BIGINT AS rank
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) WHERE rank <= 2000
"""
