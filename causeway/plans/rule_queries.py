"""The tiered classifier and what follows from it: scope, fallback targets, polarity, tags, extraction. With the same cascade as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import rules as R
from causeway.operators.overlap import similar_sets
from causeway.plans.registry import register
from causeway.scratch import materialize
from causeway.sources import fixtures as X

#: Rules of our own that fire on the driver's texts: their real words are function words of four languages.
GUARDS: tuple[R.Guard, ...] = (
    ("reader_service", (r"^for ",), "OTHER"), ("resignation_opinion", (" will ", " by "), "OTHER"), ("reported_joke", (" un ", " la "), "TENSION"), ("denied_event", (" not? (the|to) ",), "OTHER"),
)
RULES = R.Rules(
    specific=(("tariff", "TRADE"), ("from", "TRADE"), ("ist", "LABOUR"), ("des", "SANCTIONS"), ("para", "DEAL"), ("rate cut", "POLICY"), ("this of", "POLICY"), ("is in", "CONFLICT"), ("not", "REGULATION")),
    generic=(("with", "DEAL"), ("mit", "DEAL"), ("un", "POLICY"), ("it", "TRADE"), ("de la", "CONFLICT")),
    reject=(("idiot", "SPORT"), ("trash", "LEISURE"), ("por", "LEISURE"), ("are", "SPORT"), ("for the", "LEISURE")),
    company=(("be", "A1"), ("by", "A2"), ("auf", "A3"), ("pour", "A4")),
    industry=(("as", "G1"), ("im", "G2"), ("at the", "G3")),
    cue=(("on", "ENERGY"), ("el", "HAVEN"), ("la", "HAVEN"), ("die", "DEFENCE")),
    transport=("to", "zu"),
    override=("a", "das"),
    terms=("that", "les"),
    sections={"src1": "SPORT", "src3": "LEISURE"},
    targets=(("TRADE", "A7", "ENERGY"), ("TRADE", "G4", "HAVEN"), ("SANCTIONS", "G5", "HAVEN"), ("CONFLICT", "A9", "DEFENCE"), ("LABOUR", "G6", "DEFENCE"), ("POLICY", "A7", "HAVEN"), ("SPORT", "A8", "HAVEN")),
    silent=("OTHER", "SPORT", "LEISURE"),
    geopolitical=("CONFLICT", "SANCTIONS"),
    guards=GUARDS,
)
POLARITY = R.PolarityRules(
    approval=("REGULATION", r" (approv|and|der) ?", r" (fine|penalt|of) ?"),
    negation=r" (collapse|no longer|was) ",
    hedge=r" (expected|might|may|un) ",
    ends={"CONFLICT": r" (ceasefire|truce|the) ", "SANCTIONS": r" (lift|lifts|lifted|la) .{0,30}(sanction|de)"},
    calls_off=r"\b(calls off|called off|cancels|cancelled|averts)",
    resolved=r" (ceasefire|truce|and|und) ",
    guards=GUARDS,
)


def articles(spark, sf):
    return X.articles(spark, sf).withColumn("section", F.col("source_id"))


def classified(spark, sf):
    return R.classify(articles(spark, sf), RULES)


# --- the same cascade as SQL ---
quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
HAY = "' ' || regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g') || ' '"
SUF = "[" + quoted(T.SUFFIXES) + "]"


def guard_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {' AND '.join(f'regexp_matches(lower({column}), {quoted([p])})' for p in patterns)} THEN '{name}'" for name, patterns, _ in GUARDS) + " END"


def guarded_sql() -> str:
    return " ".join(f"WHEN '{name}' THEN '{kind}'" for name, _, kind in GUARDS)


def first_sql(role: str, place: str) -> str:
    on = f"FILTER (role = '{role}' AND field = '{place}')"
    order = "{'p': pos, 'l': -length(keyword), 'k': keyword}"
    return f"arg_min(value, {order}) {on} AS {place}_{role}, arg_min(keyword, {order}) {on} AS {place}_{role}_k"


def named_sql(role: str) -> str:
    return f"coalesce(list_sort(list(DISTINCT value) FILTER (role = '{role}' AND field = 'title')), []) AS {role}"


SCAN = f"""{X.ARTICLES}, {X.values(RULES.rows(), "rule", "role, keyword, value")},
hay AS (SELECT article_id, 'title' AS field, {HAY.format("title")} AS hay FROM articles UNION ALL SELECT article_id, 'body', {HAY.format("body")} FROM articles),
hit AS (SELECT article_id, field, role, keyword, value, min(instr(hay, ' ' || keyword || s || CASE WHEN contains(keyword, ' ') THEN '' ELSE ' ' END)) AS pos
  FROM hay, rule, unnest({SUF}) AS u(s) WHERE contains(hay, ' ' || keyword || s || CASE WHEN contains(keyword, ' ') THEN '' ELSE ' ' END) GROUP BY ALL),
sig AS (SELECT article_id, {", ".join(first_sql(*x) for x in (("specific", "title"), ("generic", "title"), ("reject", "title"), ("specific", "body"), ("reject", "body")))},
  {", ".join(map(named_sql, ("company", "industry", "cue", "transport", "override", "terms")))} FROM hit GROUP BY article_id),
b AS (SELECT a.article_id, a.title, a.body, s.* EXCLUDE (article_id, company, industry, cue, transport, override, terms), coalesce(company, []) AS company, coalesce(industry, []) AS industry, coalesce(cue, []) AS cue,
  coalesce(transport, []) AS transport, coalesce(len(company), 0) = 0 AND coalesce(len(override), 0) = 0 AS free, {guard_sql("a.title")} AS tripped,
  CASE source_id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RULES.sections.items())} END AS sec,
  coalesce(len(company), 0) + coalesce(len(industry), 0) + coalesce(len(terms), 0) + coalesce(len(cue), 0) > 0 OR coalesce(regexp_matches(title, '{R.MONEY}'), false) AS corroborated FROM articles a LEFT JOIN sig s USING (article_id)),
f AS (SELECT *, CASE WHEN title_specific IS NOT NULL THEN title_specific WHEN corroborated AND title_generic IS NOT NULL THEN title_generic ELSE body_specific END AS ft,
  CASE WHEN title_specific IS NOT NULL THEN title_specific_k WHEN corroborated AND title_generic IS NOT NULL THEN title_generic_k ELSE body_specific_k END AS fk,
  CASE WHEN title_specific IS NOT NULL OR corroborated AND title_generic IS NOT NULL THEN 'title' WHEN body_specific IS NOT NULL THEN 'body' END AS fs FROM b),
g AS (SELECT *, ft IS NOT NULL AND len(company) = 0 AND len(industry) = 0 AND body_reject IS NOT NULL AS vetoed,
  CASE WHEN tripped IS NOT NULL THEN 'guard' WHEN free AND sec IS NOT NULL THEN 'section' WHEN free AND title_reject IS NOT NULL THEN 'reject' WHEN ft IS NOT NULL AND len(company) = 0 AND len(industry) = 0 AND body_reject IS NOT NULL THEN 'veto' WHEN ft IS NOT NULL THEN 'found' ELSE 'other' END AS way FROM f),
dec AS (SELECT article_id, title, body, company, industry, cue, transport, corroborated, vetoed,
  CASE way WHEN 'guard' THEN CASE tripped {guarded_sql()} END WHEN 'section' THEN sec WHEN 'reject' THEN title_reject WHEN 'veto' THEN body_reject WHEN 'found' THEN ft ELSE 'OTHER' END AS event_type,
  CASE way WHEN 'section' THEN 'section:' || lower(sec) WHEN 'reject' THEN title_reject_k WHEN 'veto' THEN body_reject_k WHEN 'found' THEN fk END AS keyword,
  CASE way WHEN 'section' THEN 'publisher_section' WHEN 'veto' THEN 'body_veto' WHEN 'found' THEN fs ELSE 'title' END AS source,
  coalesce(tripped, CASE WHEN way = 'other' THEN 'unmapped' ELSE 'tiered_rule' END) AS reason FROM g)"""
MEM = X.MEMBERS
TARGETS = f"""{X.values(list(RULES.targets), "tg", "event_type, target, family")}, {MEM},
tt AS (SELECT event_type, asset_id, family FROM tg JOIN members ON target = group_id UNION ALL SELECT event_type, target, family FROM tg WHERE target NOT IN (SELECT group_id FROM members))"""
GATED = "fb AS (SELECT DISTINCT article_id, asset_id FROM dec JOIN tt USING (event_type) WHERE list_contains(cue, family) AND " + guard_sql("title") + " IS NULL)"


@register("t02_keyword_match", f"WITH {SCAN} SELECT article_id, field, role, keyword FROM hit")
def t02(spark, sf):
    return R.scan(articles(spark, sf), R.rule_table(spark, RULES.rows()), "article_id", ["title", "body"]).select("article_id", "field", "role", "keyword")


@register("t03_earliest_keyword", f"WITH {SCAN} SELECT article_id, title_specific_k AS specific, title_generic_k AS generic, body_specific_k AS in_body, body_reject_k AS rejected FROM sig")
def t03(spark, sf):
    k = lambda c: F.col(f"{c}.keyword")
    return R.signals(articles(spark, sf), RULES).select("article_id", k("title_specific").alias("specific"), k("title_generic").alias("generic"), k("body_specific").alias("in_body"), k("body_reject").alias("rejected"))


@register("t04_classify", f"WITH {SCAN} SELECT article_id, event_type, keyword, source, reason FROM dec")
def t04(spark, sf):
    return classified(spark, sf).select("article_id", "event_type", "keyword", "source", "reason")


@register("t05_corroboration", f"WITH {SCAN} SELECT article_id, corroborated, len(company)::INT AS companies, len(industry)::INT AS industries, len(cue)::INT AS families FROM dec")
def t05(spark, sf):
    return classified(spark, sf).select("article_id", "corroborated", F.size("company").alias("companies"), F.size("industry").alias("industries"), F.size("cue").alias("families"))


@register("t06_body_veto", f"WITH {SCAN} SELECT event_type, source, vetoed, count(*)::BIGINT AS n FROM dec GROUP BY ALL")
def t06(spark, sf):
    return classified(spark, sf).groupBy("event_type", "source", "vetoed").agg(F.count(F.lit(1)).alias("n"))


SENTENCES = "string_split_regex(regexp_replace(trim({0}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
BEARS = f"len(list_filter({SUF}, lambda s: contains({HAY.format('x')}, ' ' || keyword || s || ' '))) > 0 OR contains(keyword, ' ') AND contains({HAY.format('x')}, keyword)"


@register("t07_decision_record", f"WITH {SCAN} SELECT article_id, event_type || '|' || coalesce(keyword, '-') || '|' || source || '|' || reason AS record, CASE WHEN source IN ('body', 'body_veto') THEN list_filter({SENTENCES.format('body')}, lambda x: {BEARS})[1] WHEN source = 'publisher_section' THEN keyword ELSE title END AS evidence, event_type = 'OTHER' AND reason = 'unmapped' AS allow_llm FROM dec")
def t07(spark, sf):
    """Each decision with what bears it out: of a body, the first sentence that holds the keyword."""
    sentence = F.try_element_at(F.filter(T.sentences(F.trim("body")), lambda s: T.has_keyword(T.haystack(s), F.col("keyword"))), F.lit(1))
    evidence = F.when(F.col("source").isin("body", "body_veto"), sentence).when(F.col("source") == "publisher_section", F.col("keyword")).otherwise(F.col("title"))
    record = F.concat_ws("|", "event_type", F.coalesce("keyword", F.lit("-")), "source", "reason")
    return classified(spark, sf).select("article_id", record.alias("record"), evidence.alias("evidence"), ((F.col("event_type") == "OTHER") & (F.col("reason") == "unmapped")).alias("allow_llm"))


LEMMAS = (("view", "SEE"), ("purchase", "BUY"), ("error", "FAIL"), ("signup", "JOIN"), ("click", "TOUCH"))


@register("t08_lemma_map", "WITH " + X.EVENTS + ", " + X.values(list(LEMMAS[:3]), "lm", "word, lemma") + " SELECT event_id, coalesce(lemma, 'OTHER') AS lemma FROM ev LEFT JOIN lm ON lower(trim(factor)) = word")
def t08(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in LEMMAS[:3] for x in kv])
    return X.events(spark, sf).select("event_id", F.coalesce(m[F.lower(F.trim("factor"))], F.lit("OTHER")).alias("lemma"))


@register("t10_scope_precedence", f"WITH {SCAN}, {TARGETS}, {GATED}, fan AS (SELECT article_id, list_sort(list(DISTINCT asset_id)) AS l FROM (SELECT article_id, unnest(industry) AS group_id FROM dec) JOIN members USING (group_id) GROUP BY 1), bt AS (SELECT article_id, list_sort(list(asset_id)) AS l FROM fb GROUP BY 1), s AS (SELECT d.article_id, d.event_type, CASE WHEN d.event_type IN ({quoted(RULES.silent)}) OR {guard_sql('d.title')} IS NOT NULL THEN 'NONE' WHEN len(company) > 0 THEN 'COMPANY' WHEN fan.l IS NOT NULL THEN 'INDUSTRY' WHEN bt.l IS NOT NULL THEN 'EVENT_TYPE' ELSE 'NONE' END AS scope, company, fan.l AS fl, bt.l AS bl FROM dec d LEFT JOIN fan USING (article_id) LEFT JOIN bt USING (article_id)) SELECT article_id, event_type, scope, CASE scope WHEN 'COMPANY' THEN array_to_string(company, ',') WHEN 'INDUSTRY' THEN array_to_string(fl, ',') WHEN 'EVENT_TYPE' THEN array_to_string(bl, ',') ELSE '' END AS assets FROM s")
def t10(spark, sf):
    m = X.edge_tables(spark, sf)["members"]
    return R.scopes(classified(spark, sf), m, R.target_table(spark, RULES, m), RULES.silent).withColumn("assets", F.array_join("assets", ","))


@register("t11_gated_fallback", f"WITH {SCAN}, {TARGETS}, {GATED} SELECT * FROM fb")
def t11(spark, sf):
    return R.fallback(classified(spark, sf), R.target_table(spark, RULES, X.edge_tables(spark, sf)["members"]))


@register("t12_ungated_fallback", f"WITH {SCAN}, {TARGETS} SELECT DISTINCT article_id, asset_id FROM dec JOIN tt USING (event_type) WHERE {guard_sql('title')} IS NULL")
def t12(spark, sf):
    return R.fallback(classified(spark, sf), R.target_table(spark, RULES, X.edge_tables(spark, sf)["members"]), gated=False)


def polarity_sql() -> str:
    hay = HAY.format("title")
    m = lambda p: f"regexp_matches(h, {quoted([p])})"
    by: dict[str, list[str]] = {}
    for k, t in RULES.specific:
        by.setdefault(t, []).append(k)
    over = [f"event_type = '{t}' AND {m(p)}" for t, p in POLARITY.ends.items()]
    over += [f"event_type = '{t}' AND {m(POLARITY.calls_off + '( +(the|a|an|planned|new)){0,2} +(' + '|'.join(ks) + ')')}" for t, ks in by.items()]
    kind, yes, no = POLARITY.approval
    return f"""SELECT article_id, event_type, CASE WHEN event_type = '{kind}' AND {m(yes)} AND NOT {m(no)} THEN 'RESOLUTION' WHEN {m(POLARITY.negation)} OR {m(POLARITY.hedge)} OR {guard_sql("title")} IS NOT NULL THEN 'OCCURRENCE'
  WHEN {" OR ".join(f"({x})" for x in over)} THEN 'RESOLUTION' ELSE 'OCCURRENCE' END AS polarity,
  CASE WHEN {m(POLARITY.negation)} THEN 'OCCURRENCE' WHEN {m(POLARITY.resolved)} THEN 'RESOLUTION' ELSE 'OCCURRENCE' END AS general FROM (SELECT *, {hay} AS h FROM dec)"""


@register("t13_polarity", f"WITH {SCAN} {polarity_sql()}")
def t13(spark, sf):
    p = R.polarity(F.col("title"), F.col("event_type"), POLARITY, RULES.specific)
    return classified(spark, sf).select("article_id", "event_type", p.alias("polarity"), R.polarity(F.col("title"), None, POLARITY).alias("general"))


@register("t14_context_tags", f"WITH {SCAN} SELECT article_id, CASE WHEN len(transport) > 0 THEN 'TRANSPORT_AFFECTED' WHEN event_type IN ({quoted(RULES.geopolitical)}) THEN 'SAFE_HAVEN_ONLY' ELSE '' END AS tags FROM dec")
def t14(spark, sf):
    tags = R.context_tags(F.col("transport"), F.col("event_type"), RULES.geopolitical)
    return classified(spark, sf).select("article_id", F.array_join(tags, ",").alias("tags"))


@register("t15_compatible", f"WITH {SCAN}, k AS (SELECT DISTINCT event_type AS t FROM dec) SELECT a.t AS a, b.t AS b, a.t = b.t AND a.t NOT IN ({quoted(RULES.silent)}) AS compatible FROM k a, k b")
def t15(spark, sf):
    kinds = sorted({v for role in ("specific", "generic", "reject") for _, v in getattr(RULES, role)} | set(RULES.sections.values()) | {kind for *_, kind in RULES.guards} | {"OTHER"})
    k = classified(spark, sf).select("event_type").distinct()  # one row an event type
    pairs = k.select(F.col("event_type").alias("a"), F.explode(F.array(*map(F.lit, kinds))).alias("b")).join(k.select(F.col("event_type").alias("b")), "b")
    return pairs.select("a", "b", R.compatible(F.col("a"), F.col("b"), RULES.silent).alias("compatible"))


STOP = quoted(R.STOPWORDS)
TERMS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')), lambda x: length(x) >= 3 AND x NOT IN (" + STOP + "))"


@register("t16_input_modes", f"WITH {X.ARTICLES}, s AS (SELECT article_id, title, coalesce(body, '') AS body, CASE language WHEN 'en' THEN 'title_first' WHEN 'fr' THEN 'title_only' ELSE 'relevant' END AS mode FROM articles), p AS (SELECT *, unnest(CASE WHEN mode = 'relevant' THEN list_filter(string_split_regex(regexp_replace(trim(body), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') ELSE [''] END) AS part FROM s), q AS (SELECT article_id, count(*) FILTER (mode = 'relevant' AND list_has_any({TERMS.format('part')}, {TERMS.format('title')})) AS n FROM p GROUP BY 1) SELECT s.article_id, mode, CASE mode WHEN 'title_first' THEN length(body) WHEN 'title_only' THEN 0 ELSE -1 END AS n_chars, CASE WHEN mode = 'relevant' THEN coalesce(n, 0) ELSE -1 END AS n_sentences FROM s LEFT JOIN q USING (article_id)")
def t16(spark, sf):
    mode = F.when(F.col("language") == "en", "title_first").when(F.col("language") == "fr", "title_only").otherwise("relevant")
    a = X.articles(spark, sf).withColumn("mode", mode).withColumn("i", R.inputs(F.col("title"), F.col("body"), F.col("mode")))
    n = F.size(F.filter(T.sentences(F.trim("body")), lambda s: F.arrays_overlap(R.terms(s), R.terms(F.col("title")))))
    return a.select("article_id", "mode", F.when(F.col("mode") != "relevant", F.length("i.body").cast("bigint")).otherwise(-1).alias("n_chars"), F.when(F.col("mode") == "relevant", n.cast("bigint")).otherwise(-1).alias("n_sentences"))


@register("t17_extracted_action", f"WITH {SCAN} SELECT article_id, company[1] AS actor, coalesce(keyword, 'OTHER') AS action_lemma, event_type, array_to_string(company[2:], ',') AS object, source || ':' || reason AS audit FROM dec")
def t17(spark, sf):
    """Who acts (the first company that the title names), what it does, and on whom (the others)."""
    c = classified(spark, sf)
    others = F.slice("company", 2, F.greatest(F.size("company"), F.lit(1)))
    return c.select("article_id", F.try_element_at("company", F.lit(1)).alias("actor"), F.coalesce("keyword", F.lit("OTHER")).alias("action_lemma"), "event_type", F.array_join(others, ",").alias("object"), F.concat_ws(":", "source", "reason").alias("audit"))


@register("c11_guards", f"WITH {X.ARTICLES} SELECT article_id, {guard_sql('title')} AS guard FROM articles")
def c11(spark, sf):
    return X.articles(spark, sf).select("article_id", R.guard(F.col("title"), GUARDS).alias("guard"))


@register("g05_term_overlap", f"WITH b AS (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, count(*)::BIGINT AS n FROM b a JOIN b ON a.term = b.term AND a.item_id < b.item_id GROUP BY ALL")
def g05(spark, sf):
    """Pairs that share a term, by an inverted index: items are joined on terms, not on each other."""
    b = X.read(spark, sf, "benchmark").select("item_id", F.explode(R.terms(F.col("text"))).alias("term"))
    j = b.alias("a").join(b.alias("b"), (F.col("a.term") == F.col("b.term")) & (F.col("a.item_id") < F.col("b.item_id")))
    return j.groupBy(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))


SETS = f"t AS (SELECT article_id, list_sort({TERMS.format('title')}) AS w FROM articles), cl AS (SELECT *, min(article_id) OVER (PARTITION BY w) AS class_id FROM t), one AS (SELECT DISTINCT class_id, w FROM cl WHERE len(w) > 0)"


@register("g05_similar_titles", f"WITH {X.ARTICLES}, {SETS} SELECT 'member' AS kind, article_id AS a, class_id AS b, 1.0::DOUBLE AS similarity FROM cl UNION ALL SELECT 'link', x.class_id, y.class_id, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::DOUBLE, 6) FROM one x JOIN one y ON x.class_id < y.class_id WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::DOUBLE >= 0.4 - 1e-9")
def g05s(spark, sf):
    """Titles whose terms are the same, and those that share most of them."""
    sets = X.articles(spark, sf).select("article_id", R.terms(F.col("title")).alias("terms"))
    members, links = similar_sets(sets, "article_id", "terms", 0.4)
    member = members.select(F.lit("member").alias("kind"), F.col("article_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("similarity"))
    return member.unionByName(links.select(F.lit("link").alias("kind"), F.col("class_a").alias("a"), F.col("class_b").alias("b"), F.round("similarity", 6).alias("similarity")))


@register("x06_predicates", f"WITH {X.ARTICLES}, k AS (SELECT unnest(['OPEN', 'QUIET', 'CLOSED', 'DONE']) AS state) SELECT article_id, state, state IN ('OPEN', 'QUIET') AS accepts, contains({HAY.format('title')}, ' and ') OR contains({HAY.format('title')}, 'de la') AS cue, bit_count(xor(article_id, article_id * 5)) <= 3 AS near FROM articles, k")
def x06(spark, sf):
    hay = T.haystack(F.coalesce("title", F.lit("")))
    states = F.explode(F.array(*map(F.lit, ("OPEN", "QUIET", "CLOSED", "DONE"))))
    a = X.articles(spark, sf).select("article_id", "title", states.alias("state"))
    return a.select("article_id", "state", F.col("state").isin("OPEN", "QUIET").alias("accepts"), (F.contains(hay, F.lit(" and ")) | F.contains(hay, F.lit("de la"))).alias("cue"), (T.hamming(F.col("article_id"), F.col("article_id") * 5) <= 3).alias("near"))


@register("x07_cluster_assets", f"WITH {SCAN}, {TARGETS}, {GATED}, ca AS (SELECT d.article_id, a.source_id, a.published_at, d.event_type, d.company FROM dec d JOIN articles a USING (article_id)), own AS (SELECT source_id, event_type, unnest(company) AS asset_id FROM ca), back AS (SELECT ca.source_id, ca.event_type, fb.asset_id FROM fb JOIN ca USING (article_id)), r AS (SELECT source_id, event_type, asset_id FROM own UNION SELECT source_id, event_type, asset_id FROM back b WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.source_id = b.source_id AND o.event_type = b.event_type)) SELECT source_id, event_type, string_agg(asset_id, ',' ORDER BY asset_id) AS assets FROM r WHERE event_type NOT IN ({quoted(RULES.silent)}) GROUP BY ALL")
def x07(spark, sf):
    """A cluster's assets: those its actions name; else the gated fallback over its titles; none for types that move nothing."""
    c = materialize(classified(spark, sf).select("article_id", "event_type", "guard", "company", "cue"), "decisions")  # it is read twice
    of = X.articles(spark, sf).select("article_id", "source_id")
    back = R.fallback(c, R.target_table(spark, RULES, X.edge_tables(spark, sf)["members"])).withColumnRenamed("asset_id", "spare")
    j = c.filter(~F.col("event_type").isin(*RULES.silent)).join(of, "article_id").select("article_id", "source_id", "event_type", "company")
    own = j.groupBy("source_id", "event_type").agg(F.array_distinct(F.flatten(F.collect_list("company"))).alias("own"))
    spare = j.join(back, "article_id").groupBy("source_id", "event_type").agg(F.collect_set("spare").alias("spare"))
    both = own.join(spare, ["source_id", "event_type"], "left")
    out = both.select("source_id", "event_type", F.array_sort(F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("spare", F.array().cast("array<string>")))).alias("assets"))
    return out.filter(F.size("assets") > 0).withColumn("assets", F.array_join("assets", ","))


@register("x09_registry_keywords", f"WITH {X.values(list(RULES.company), 'ck', 'keyword, asset_id')}, {MEM} SELECT group_id, m.asset_id, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM members m JOIN ck ON ck.asset_id = m.asset_id GROUP BY ALL")
def x09(spark, sf):
    """Keyword table of each registered asset, from arrays in the registry."""
    registry = spark.createDataFrame([(a, [k for k, x in RULES.company if x == a]) for a in dict.fromkeys(x for _, x in RULES.company)], "asset_id string, keywords array<string>")
    return registry.join(X.edge_tables(spark, sf)["members"], "asset_id").select("group_id", "asset_id", F.array_join(F.array_sort("keywords"), ",").alias("keywords"))


@register("x10_rule_assertions", f"WITH {TARGETS}, {X.values(list(RULES.cue), 'cu', 'cue, family')}, {X.values(list(RULES.sections.items()), 'se', 'section, event_type')} SELECT 'TARGET_WITHOUT_FAMILY' AS rule, target AS key FROM tg WHERE family NOT IN (SELECT family FROM cu) UNION ALL SELECT 'UNKNOWN_TARGET', target FROM tg WHERE target NOT IN (SELECT asset_id FROM members) AND target NOT IN (SELECT group_id FROM members) UNION ALL SELECT 'MARKET_SECTION', section FROM se WHERE event_type NOT IN ({quoted(RULES.silent)})")
def x10(spark, sf):
    """Faults of the rule tables: none, if they may be loaded."""
    m = X.edge_tables(spark, sf)["members"]
    t = spark.createDataFrame(list(RULES.targets), "event_type string, key string, family string")
    families = spark.createDataFrame(list(RULES.cue), "cue string, family string")
    sections = spark.createDataFrame(list(RULES.sections.items()), "key string, event_type string")
    known = m.select(F.col("asset_id").alias("key")).union(m.select("group_id"))
    faults = lambda rule, df: df.select(F.lit(rule).alias("rule"), "key")
    return faults("TARGET_WITHOUT_FAMILY", t.join(families, "family", "left_anti")).union(faults("UNKNOWN_TARGET", t.join(known, "key", "left_anti"))).union(faults("MARKET_SECTION", sections.filter(~F.col("event_type").isin(*RULES.silent))))


#: Ten headlines of our own with the verdict each must get.
SMOKE = (
    (1, "Tariff raised by council", "", "src0", "TRADE"), (2, "A quiet day", "", "src1", "OTHER"), (3, "Quiet day", "", "src1", "SPORT"), (4, "What an idiot", "", "src0", "SPORT"), (5, "Idiot comes to pour steel, tariff says", "", "src0", "TRADE"),
    (6, "Deal with rival", "", "src0", "OTHER"), (7, "Deal with rival worth 12%", "", "src0", "DEAL"), (8, "Tariff news", "Trash talk all day", "src0", "LEISURE"), (9, "Silence", "A rate cut came", "src0", "POLICY"), (10, "For readers: tariff table", "", "src0", "OTHER"),
)


@register("x33_smoke_rules", f"WITH {SCAN}, nth AS (SELECT article_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY article_id) AS n FROM dec) SELECT article_id, event_type, true AS ok FROM nth WHERE n <= 10 UNION ALL SELECT -id::BIGINT, want, true FROM ({'SELECT * FROM (VALUES ' + ', '.join(f'({i}, {quoted([w])})' for i, _, _, _, w in SMOKE) + ') v(id, want)'})")
def x33(spark, sf):
    """Ten articles of each verdict, and the headlines of SMOKE under negative ids, judged again apart from the table: each must get its verdict."""
    table = articles(spark, sf)
    nth = F.row_number().over(Window.partitionBy("want").orderBy("article_id"))
    some = classified(spark, sf).select("article_id", F.col("event_type").alias("want")).withColumn("n", nth).filter("n <= 10").drop("n")
    own = spark.createDataFrame([(-i, *rest) for i, *rest in SMOKE], "article_id bigint, title string, body string, section string, want string")
    rows = materialize(table.join(some, "article_id").select(own.columns).unionByName(own), "smoke")
    got = R.classify(rows, RULES).select("article_id", "event_type")
    return got.join(rows.select("article_id", "want"), "article_id").select("article_id", "event_type", (F.col("event_type") == F.col("want")).alias("ok"))
