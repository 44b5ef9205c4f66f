"""Queries over the text tables for the rule-based classifier, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import classify as C
from ..operators import dictionary as Dict
from ..operators import pattern_table as P
from ..operators.progressive import progressive_decision
from ..session import table
from .registry import query

#: Rules made of words that occur in the generated texts.
CORPUS = R.RuleSet(
    product_terms=("licensed under", "onen", "heen", "tion", "las", "der"),
    goods_terms=("erest", "ouin", "und", "que"),
    weak_terms=("heen", "las"),
    incidental=(r"to\s+the", r"of\s+the\s+tion", r"de\s+las?"),
    excluded=(("mail", r"mail[0-9]"), ("insult", r"idiot|clown")),
    services=(("hand", r"hand|anand"), ("wheel", r"whe[a-z]*on")),
    physical=(("estate", r"esth?at[a-z]*"), ("thing", r"things?")),
    categories=(("license text", r"apache\s+license"), ("inner", r"inin")),
    context={
        "telecom": r"ingly", "connectivity": r"shth|whwh", "event": r"ever", "consulting": r"conn?", "purchase": r"was",
        "dedicated": r"onen\s+the|der\s+und", "subscription_context": r"ver|ueue", "license": r"by", "license_object": r"for",
        "hardware_bundle": r"with", "event_purchase": r"onen\s+of", "purchase_unit": r"in",
    },
    subscription_term="heen",
    generic_term="tion",
    event_term="onen",
)
STOPS = ("small", "large", "green")
DOCS = "documents"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_terms(text: str, terms) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, {_q(R.term_pattern(t))}) THEN {_q(t)} END" for t in terms) + "], lambda x: x IS NOT NULL)"


def sql_label(text: str, family) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q(R.bounded(p))}) THEN {_q(n)}" for n, p in family) + " END"


def sql_stripped(text: str, rules=CORPUS) -> str:
    for p in rules.incidental:
        text = f"regexp_replace({text}, {_q('(?i)' + p)}, ' ', 'g')"
    return text


def sql_evidence(source: str, keys: str, text: str = "text", rules=CORPUS) -> str:
    """CTE body: keys, src, products, goods, labels and flags."""
    has = lambda n: f"regexp_matches(src, {_q(R.bounded(rules.context[n]))})"
    weak = "[" + ", ".join(map(_q, rules.weak_terms)) + "]"
    only = lambda t: f"len(list_filter(strong, lambda x: x <> {_q(t)})) = 0"
    return f"""
SELECT *, f_wsub AND h_tel AS f_tel, h_con AND NOT f_ded AND f_generic AS f_con, h_ev AND NOT f_ded AND NOT h_evbuy AND f_strong AND {only(rules.event_term)} AS f_ev,
  f_wsub AND h_sub AS f_sub, h_lic AND h_obj AND NOT h_hw AS f_lic,
  f_strong AND f_generic AND NOT f_ded AND NOT f_buy AND NOT (h_lic AND h_obj AND NOT h_hw) AND NOT (f_wsub AND h_sub) AS f_alone
FROM (SELECT *, len(products) > 0 AS f_any, len(goods) > 0 AS f_goods, len(strong) > 0 AS f_strong, {only(rules.generic_term)} AS f_generic,
  len(products) > 0 AND len(strong) = 0 AND list_contains(products, {_q(rules.subscription_term)}) AS f_wsub, h_buy OR (f_ded AND h_unit) AS f_buy
FROM (SELECT *, list_filter(products, lambda x: NOT list_contains({weak}, x)) AS strong, {has('dedicated')} AS f_ded, {has('purchase')} AS h_buy, {has('purchase_unit')} AS h_unit,
  {has('telecom')} AS h_tel, {has('connectivity')} AS h_con, {has('event')} AS h_ev, {has('event_purchase')} AS h_evbuy,
  {has('consulting')} AS f_cons, {has('subscription_context')} AS h_sub, {has('license')} AS h_lic, {has('license_object')} AS h_obj, {has('hardware_bundle')} AS h_hw
FROM (SELECT *, {sql_terms('src', rules.product_terms)} AS products, {sql_terms('src', rules.goods_terms)} AS goods, {sql_label('src', rules.excluded)} AS excluded,
  {sql_label('src', rules.services)} AS service, {sql_label('src', rules.physical)} AS physical, {sql_label('src', rules.categories)} AS cat
  FROM (SELECT {keys}, {sql_stripped(f"coalesce({text}, '')")} AS src FROM {source}))))"""


RULE_SQL = """CASE WHEN excluded IS NOT NULL THEN 'excluded product' WHEN f_tel THEN 'telecom' WHEN f_con THEN 'connectivity'
 WHEN f_ev THEN 'event' WHEN f_cons AND NOT f_buy THEN 'consulting' WHEN f_cons THEN 'consulting with purchase'
 WHEN service IS NOT NULL AND NOT f_strong THEN 'service' WHEN service IS NOT NULL THEN 'service with product'
 WHEN physical IS NOT NULL AND NOT f_strong THEN 'physical' WHEN physical IS NOT NULL THEN 'physical with product'
 WHEN cat IS NOT NULL AND (f_ded OR f_buy) THEN 'category with product' WHEN cat IS NOT NULL AND f_generic THEN 'category' WHEN cat IS NOT NULL THEN 'category unclear'
 WHEN f_ded AND NOT f_goods THEN 'dedicated product' WHEN f_any AND NOT f_strong AND NOT f_goods AND f_sub THEN 'weak term in context'
 WHEN f_any AND NOT f_strong AND NOT f_goods THEN 'weak term' WHEN NOT f_any AND NOT f_goods AND f_lic THEN 'license'
 WHEN f_any AND NOT f_goods THEN 'product terms' WHEN f_goods AND NOT f_any THEN 'goods terms' WHEN f_goods THEN 'both' ELSE 'no terms' END"""
OUTCOME = {
    "product": ("dedicated product", "weak term in context", "license", "product terms"),
    "review": ("consulting with purchase", "service with product", "physical with product", "category with product", "category unclear", "weak term", "both", "no terms"),
}


def sql_outcome(rule: str) -> str:
    lists = {k: ", ".join(map(_q, v)) for k, v in OUTCOME.items()}
    return f"CASE WHEN {rule} IN ({lists['product']}) THEN 'product' WHEN {rule} IN ({lists['review']}) THEN 'review' ELSE 'not relevant' END"


def sql_classified(source: str = DOCS, keys: str = "doc_id", text: str = "text") -> str:
    return f"SELECT *, {sql_outcome('rule')} AS label FROM (SELECT *, {RULE_SQL} AS rule FROM ({sql_evidence(source, keys, text)}))"


def _classified(spark, sf, keep=False):
    return C.classify(table(spark, sf, DOCS), "text", CORPUS, keep=keep).withColumn("label", C.label(F.col("relevance")))


@query("a1_classification_counts", f"SELECT label, rule, count(*)::BIGINT AS n FROM ({sql_classified()}) GROUP BY ALL")
def a1_rules(spark, sf):
    """Documents by class and by rule."""
    return _classified(spark, sf).groupBy("label", F.col("relevance.rule").alias("rule")).agg(F.count("*").alias("n"))


@query("t1_dictionary_terms", f"SELECT doc_id, array_to_string({sql_terms('text', CORPUS.product_terms + CORPUS.goods_terms)}, ',') AS terms FROM documents")
def t1(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", F.array_join(R.terms_found(F.col("text"), CORPUS.product_terms + CORPUS.goods_terms), ",").alias("terms"))


_WORDS = "list_filter(regexp_split_to_array(r, '\\s+'), lambda w: w <> '')"
_RUNS = "unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_\\s]+'))"


def _grams(source: str, keys: str) -> str:
    """Words and pairs of words of each row, one after the other in a run."""
    return f"""(WITH r AS (SELECT {keys}, {_RUNS} AS r FROM {source}), w AS (SELECT {keys}, {_WORDS} AS w FROM r)
SELECT DISTINCT {keys}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM w)"""


@query(
    "t1_large_dictionary",
    f"""WITH terms AS (SELECT gram, row_number() OVER (ORDER BY md5(gram)) AS place FROM (SELECT DISTINCT gram FROM {_grams('benchmark', 'item_id')})),
hits AS (SELECT DISTINCT doc_id, place, t.gram FROM {_grams('documents', 'doc_id')} g JOIN terms t ON g.gram = t.gram OR g.gram = t.gram || 's')
SELECT d.doc_id, count(gram)::BIGINT AS n, md5(coalesce(string_agg(gram, ',' ORDER BY place), '')) AS digest FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY 1""",
)
def t1_large(spark, sf):
    """All words and pairs of words of the benchmark, some ten thousand terms, in documents."""
    items = table(spark, sf, "benchmark").select(F.explode(Dict.ngrams(Dict.phrases(F.col("text")), [1, 2])).alias("gram")).distinct()
    entries = Dict.dictionary(items.withColumn("place", F.md5("gram")), "gram", "place")
    got = Dict.dictionary_terms(table(spark, sf, DOCS), "doc_id", "text", entries)
    return got.select("doc_id", F.size("terms").cast("bigint").alias("n"), F.md5(F.array_join("terms", ",")).alias("digest"))


@query("t2_strip_incidental", f"SELECT doc_id, length(s)::INT AS n, md5(s) AS digest FROM (SELECT doc_id, {sql_stripped('text')} AS s FROM documents)")
def t2(spark, sf):
    s = R.stripped(F.col("text"), CORPUS.incidental)
    return table(spark, sf, DOCS).select("doc_id", F.length(s).alias("n"), F.md5(s).alias("digest"))


@query(
    "t3_family_labels",
    f"SELECT doc_id, {sql_label('text', CORPUS.excluded)} AS excluded, {sql_label('text', CORPUS.services)} AS service, {sql_label('text', CORPUS.physical)} AS physical FROM documents",
)
def t3(spark, sf):
    t = F.col("text")
    labels = {"excluded": CORPUS.excluded, "service": CORPUS.services, "physical": CORPUS.physical}
    return table(spark, sf, DOCS).select("doc_id", *(R.first_label(t, f).alias(n) for n, f in labels.items()))


_SETS = {"excluded": CORPUS.excluded, "service": CORPUS.services, "physical": CORPUS.physical}


@query(
    "t3_table_labels",
    " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule_set, {sql_label('text', f)} AS label FROM documents WHERE {sql_label('text', f)} IS NOT NULL" for n, f in _SETS.items()),
)
def t3_table(spark, sf):
    """The families as rows of a table."""
    rows = [(n, i, label, R.bounded(p), None) for n, f in _SETS.items() for i, (label, p) in enumerate(f)]
    rules = P.pattern_rows(spark.createDataFrame(rows, "rule_set string, step int, label string, pattern string, anchor string"))
    return P.table_labels(table(spark, sf, DOCS), "doc_id", "text", rules)


@query(
    "t4_context_flags",
    f"SELECT doc_id, f_any AND NOT f_strong AS weak_only, f_tel AS telecom, f_sub AS subscription, f_lic AS license, f_ded AS dedicated, f_buy AS purchase FROM ({sql_evidence(DOCS, 'doc_id')})",
)
def t4(spark, sf):
    e = C.evidence(table(spark, sf, DOCS), "text", CORPUS)
    names = {"is_weak_only": "weak_only", "is_telecom": "telecom", "is_subscription_context": "subscription", "is_license_object": "license", "is_dedicated": "dedicated", "is_purchase": "purchase"}
    return e.select("doc_id", *(F.col(a).alias(b) for a, b in names.items()))


@query(
    "t5_override_flags",
    f"SELECT doc_id, f_con AS connectivity, f_ev AS event, f_cons AND NOT f_buy AS consulting, f_cons AND f_buy AS mixed FROM ({sql_evidence(DOCS, 'doc_id')})",
)
def t5(spark, sf):
    e = C.evidence(table(spark, sf, DOCS), "text", CORPUS)
    return e.select("doc_id", F.col("is_connectivity").alias("connectivity"), F.col("is_event").alias("event"), F.col("is_consulting").alias("consulting"), F.col("is_consulting_mixed").alias("mixed"))


_CONFIDENCE = """CASE WHEN label = 'product' THEN CASE WHEN len(products) = 1 AND len(strong) = 0 THEN 0.75 ELSE 0.9 END WHEN rule = 'both' THEN 0.5
 WHEN rule = 'no terms' THEN 0.3 WHEN label = 'review' THEN 0.4 ELSE 0.9 END::DOUBLE"""


@query("t6_decisions", f"SELECT doc_id, rule, label, label = 'product' AS is_relevant, label = 'review' AS needs_review, {_CONFIDENCE} AS confidence FROM ({sql_classified()})")
def t6(spark, sf):
    r = F.col("relevance")
    return _classified(spark, sf).select("doc_id", r["rule"].alias("rule"), "label", *(r[n].alias(n) for n in ("is_relevant", "needs_review", "confidence")))


def sql_excerpt(flat: str, term: str) -> str:
    """SQL of T7 on a text whose white space is collapsed."""
    hit = f"regexp_extract({flat}, {_q(R.term_pattern(term))})"
    begin, end = f"greatest(instr({flat}, {hit}) - 70, 1)", f"least(instr({flat}, {hit}) + length({hit}) + 70, length({flat}) + 1)"
    return f"CASE WHEN {begin} > 1 THEN '...' ELSE '' END || substr({flat}, {begin}, {end} - {begin}) || CASE WHEN {end} <= length({flat}) THEN '...' ELSE '' END"


def _sql_quotes() -> str:
    parts = [
        f"CASE WHEN list_contains({col}[1:4], {_q(t)}) THEN {_q(t + ': ')} || {sql_excerpt('flat', t)} END"
        for col, terms in (("products", CORPUS.product_terms), ("goods", CORPUS.goods_terms))
        for t in terms
    ]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_SAID = "CASE rule " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.SENTENCES.items()) + " END"
_QUOTING = ", ".join(map(_q, C.QUOTING))


@query(
    "t6_reasons",
    f"""WITH c AS (SELECT *, trim(regexp_replace(src, '\\s+', ' ', 'g')) AS flat FROM ({sql_classified()}))
SELECT doc_id, array_to_string(CASE WHEN rule IN ({_QUOTING}) THEN {_sql_quotes()} ELSE [{_SAID}] END, '|') AS reasons,
  coalesce(CASE WHEN rule = 'excluded product' THEN excluded WHEN rule LIKE 'service%' THEN service WHEN rule LIKE 'physical%' THEN physical WHEN rule LIKE 'category%' THEN cat
  WHEN label = 'product' AND len(products) > 0 THEN array_to_string(products[1:3], ', ') END, '') AS notes FROM c""",
)
def t6_reasons(spark, sf):
    """Why each document has its class."""
    why, notes = C.explained(F.col("relevance"), CORPUS)
    return _classified(spark, sf, keep=True).select("doc_id", F.array_join(why, "|").alias("reasons"), F.array_join(notes, "|").alias("notes"))


#: Each document with the title of a notice, which is an input of its own.
TITLED = "(SELECT d.*, b.text AS title FROM documents d, (SELECT count(*) AS n FROM benchmark) n JOIN benchmark b ON d.doc_id % n.n = b.item_id)"


def titled(spark, sf):
    """Documents with the title of a notice: one of the benchmark texts, a table of bounded size."""
    titles = table(spark, sf, "benchmark").select(F.col("item_id").alias("__item"), F.col("text").alias("title"))
    return table(spark, sf, DOCS).join(titles, F.col("doc_id") % titles.count() == F.col("__item")).drop("__item")


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_HIT = f"regexp_extract(flat, {_q(R.term_pattern('onen'))})"


@query(
    "t7_excerpts",
    f"""WITH f AS (SELECT doc_id, {_FLAT} AS flat FROM documents), h AS (SELECT doc_id, flat, {_HIT} AS hit, instr(flat, {_HIT}) AS p FROM f),
e AS (SELECT *, greatest(p - 70, 1) AS b, least(p + length(hit) + 70, length(flat) + 1) AS e FROM h WHERE hit <> '')
SELECT doc_id, CASE WHEN b > 1 THEN '...' ELSE '' END || substr(flat, b, e - b) || CASE WHEN e <= length(flat) THEN '...' ELSE '' END AS quote FROM e""",
)
def t7(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", R.excerpt(F.col("text"), "onen").alias("quote")).filter("quote IS NOT NULL")


@query(
    "t8_unreadable_document",
    f"SELECT item_id, 'unreadable, ' || rule AS rule, true AS needs_review, 0.35::DOUBLE AS confidence FROM ({sql_classified('benchmark', 'item_id')})",
)
def t8(spark, sf):
    r = C.without_document(F.col("relevance"))
    got = C.classify(table(spark, sf, "benchmark"), "text", CORPUS).withColumn("r", r)
    return got.select("item_id", "r.rule", "r.needs_review", "r.confidence")


@query(
    "t10_title_veto",
    f"""WITH d AS ({sql_classified()}), b AS ({sql_classified('benchmark', 'item_id')}), n AS (SELECT count(*) AS n FROM benchmark)
SELECT d.doc_id, CASE WHEN b.label = 'not relevant' AND d.label <> 'not relevant' THEN b.rule ELSE d.rule END AS rule
FROM d, n JOIN b ON d.doc_id % n.n = b.item_id""",
)
def t10(spark, sf):
    titles = table(spark, sf, "benchmark")
    n = titles.count()
    docs = C.classify(table(spark, sf, DOCS), "text", CORPUS, "document").withColumn("item_id", F.col("doc_id") % n)
    return docs.join(C.classify(titles, "text", CORPUS, "title").select("item_id", "title"), "item_id").select(
        "doc_id", C.vetoed(F.col("document"), F.col("title"))["rule"].alias("rule")
    )


_PARTS = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n+'), lambda s: trim(s)), lambda s: s <> '')"
_EITHER = R.bounded("|".join([p for _, p in CORPUS.services] + [rf"{t}s?" for t in CORPUS.goods_terms]))
_STRONG = R.bounded("|".join(r"\s+".join(t.split()) + "s?" for t in CORPUS.strong_terms))


@query(
    "t11_item_focus",
    f"""WITH p AS (SELECT doc_id, {_PARTS} AS parts FROM documents),
f AS (SELECT *, list_filter(parts, lambda s: regexp_matches(s, {_q(_EITHER)})) AS named FROM p)
SELECT doc_id, md5(array_to_string(CASE WHEN len(named) > 0 AND len(list_filter(named, lambda s: regexp_matches(s, {_q(_STRONG)}))) = 0 THEN named ELSE parts END, chr(10))) AS digest FROM f""",
)
def t11(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", F.md5(C.item_focus(C.sentences(F.col("text"), True), CORPUS)).alias("digest"))


@query("t12_lines", f"SELECT doc_id, len(p)::INT AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, {_PARTS} AS p FROM documents)")
def t12(spark, sf):
    p = C.sentences(F.col("text"), newline_only=True)
    return table(spark, sf, DOCS).select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("digest"))


@query("t12_sentences")
def t12_full(spark, sf):
    """Sentences also end after a stop and a space, which needs a lookbehind that the SQL engine lacks."""
    return table(spark, sf, DOCS).select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("pos", "sentence"))


_STOPS = "[" + ", ".join(map(_q, STOPS)) + "]"


def _title_sql(col: str, shortest: int) -> str:
    words = f"list_filter(regexp_extract_all(lower({col}), '[a-z0-9]+'), lambda w: len(w) >= {shortest} AND NOT list_contains({_STOPS}, w))"
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"


@query("t13_title_words", f"SELECT p_partkey, array_to_string({_title_sql('p_name', 4)}, ' ') AS words FROM part")
def t13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(C.title_words(F.col("p_name"), STOPS, 4), " ").alias("words"))


def _sql_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9_]+')"


def _sql_held(words: str, tokens: str) -> str:
    return f"list_filter({words}, lambda w: list_contains({tokens}, w) OR list_contains({tokens}, w || 's'))"


@query(
    "t14_related_passages",
    f"""WITH p AS (SELECT doc_id, {_PARTS.replace("coalesce(text, '')", sql_stripped("coalesce(text, '')"))} AS parts, {_title_sql("title", 5)} AS words FROM {TITLED}),
q AS (SELECT *, list_transform(parts, lambda s: {_sql_tokens("s")}) AS tokens FROM p)
SELECT doc_id, len(r)::INT AS n, md5(array_to_string(r, chr(10))) AS digest FROM (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN parts ELSE list_filter(parts, lambda s, i: len({_sql_held("words", "tokens[i]")}) > 0) END AS r FROM q)""",
)
def t14(spark, sf):
    words = C.title_words(F.col("title"), STOPS)
    rows = titled(spark, sf).select("doc_id", C.sentences(R.stripped(F.col("text"), CORPUS.incidental), True).alias("parts"), words.alias("words"))
    r = C.related_passages(F.col("parts"), F.col("words"))
    return rows.select("doc_id", r.alias("r")).select("doc_id", F.size("r").alias("n"), F.md5(F.array_join("r", "\n")).alias("digest"))


@query(
    "t15_identifiers",
    """WITH x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[a-z]+[0-9]+'), lambda s: upper(s)) AS x FROM documents)
SELECT doc_id, array_to_string(list_filter(x, lambda s, i: list_position(x, s) = i), ',') AS ids FROM x""",
)
def t15(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", F.array_join(C.identifiers(F.col("text"), "[a-z]+[0-9]+"), ",").alias("ids"))


MARKER = r"\n(The|Of|De|Der|And) "


_TITLE_IDS = f"list_transform(regexp_extract_all(title, '{MARKER}', 1), lambda x: upper(x))"


def sql_sections(source: str, text: str) -> str:
    """CTEs that end in ``best``: doc_id, title, section_id, score, n_sections, uncertain, section."""
    return f"""d AS (SELECT doc_id, title, coalesce({text}, '') AS text, {_title_sql("title", 5)} AS words, {_TITLE_IDS} AS ids FROM {source}),
c AS (SELECT doc_id, words, ids, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS chunk FROM (SELECT doc_id, words, ids, string_split(regexp_replace(text, '{MARKER}', chr(1) || '\\0', 'g'), chr(1)) AS x FROM d)),
n AS (SELECT *, upper(regexp_extract(chunk, '{MARKER}', 1)) AS section_id FROM c),
s AS (SELECT doc_id, section_id, any_value(words) AS words, any_value(ids) AS ids, string_agg(chunk, chr(10) ORDER BY pos) AS section, min(pos) AS pos FROM n WHERE section_id <> '' GROUP BY doc_id, section_id),
k AS (SELECT *, {_sql_tokens("section")} AS tokens FROM s),
h AS (SELECT *, {_sql_held("words", "tokens")} AS held FROM k),
a AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k, flatten(list(held) OVER (PARTITION BY doc_id)) AS every FROM h),
sc AS (SELECT *, CASE WHEN list_contains(ids, section_id) THEN 100 ELSE len(list_filter(held, lambda w: len(list_filter(every, lambda v: v = w)) < k)) END AS score FROM a),
r AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS next FROM sc WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, pos)),
best AS (SELECT d.doc_id, title, CASE WHEN k >= 2 THEN section_id END AS section_id, CASE WHEN k >= 2 THEN score END::INT AS score, coalesce(k, 0)::BIGINT AS n_sections,
  coalesce(k, 0) >= 2 AND (score <= 0 OR (score = coalesce(next, -1) AND score < 100)) AS uncertain, CASE WHEN coalesce(k, 0) < 2 THEN text ELSE section END AS section
FROM d LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON d.doc_id = r.doc_id)"""


@query(
    "t16_best_section",
    f"WITH {sql_sections(TITLED, 'text')} SELECT doc_id, section_id, score, n_sections, uncertain, md5(CASE WHEN uncertain THEN '' ELSE section END) AS digest FROM best",
)
def t16(spark, sf):
    ids = F.transform(F.regexp_extract_all("title", F.lit(MARKER), F.lit(1)), lambda x: F.upper(x))
    docs = titled(spark, sf).select("doc_id", "text", C.title_words(F.col("title"), STOPS).alias("words"), ids.alias("ids"))
    got = C.best_sections(docs, "doc_id", "text", "words", MARKER, ids_col="ids")
    return got.select("doc_id", "section_id", "score", "n_sections", "uncertain", F.md5("section").alias("digest"))


_FOCUS = f"""SELECT doc_id, title, section_id, uncertain, CASE WHEN len(named) > 0 AND len(list_filter(named, lambda s: regexp_matches(s, {_q(_STRONG)}))) = 0
  THEN array_to_string(named, chr(10)) ELSE section END AS focus
FROM (SELECT *, list_filter({_PARTS.replace("coalesce(text, '')", "section")}, lambda s: regexp_matches(s, {_q(_EITHER)})) AS named FROM best)"""


_T10 = f"""{sql_sections(TITLED, sql_stripped("coalesce(text, '')"))}, f AS ({_FOCUS}),
x AS ({sql_classified('f', 'doc_id, section_id, uncertain', 'focus')}), t AS ({sql_classified('f', 'doc_id', 'title')}),
o AS (SELECT sc.doc_id, list('products in another section: ' || sc.section_id ORDER BY sc.pos) AS others FROM sc JOIN best ON sc.doc_id = best.doc_id
  WHERE sc.section_id <> best.section_id AND len({sql_terms("sc.section", tuple(t for t in CORPUS.product_terms if t != "heen"))}) > 0 GROUP BY 1),
z AS (SELECT x.doc_id, x.section_id, t.label AS title_label, t.rule AS title_rule, NOT x.uncertain AND t.label = 'not relevant' AND x.label <> 'not relevant' AS vetoed, x.uncertain,
  CASE WHEN x.uncertain THEN 'section unclear' WHEN vetoed THEN t.rule ELSE x.rule END AS rule, CASE WHEN x.uncertain THEN 'review' WHEN vetoed THEN 'not relevant' ELSE x.label END AS label,
  list_concat(CASE WHEN best.n_sections < 2 THEN [] WHEN x.uncertain THEN ['no one section of this notice'] ELSE list_concat(['section ' || x.section_id], coalesce(others, [])) END,
    CASE WHEN vetoed THEN ['the title''s exclusion stands'] ELSE [] END) AS notes
  FROM x JOIN t ON x.doc_id = t.doc_id JOIN best ON x.doc_id = best.doc_id LEFT JOIN o ON x.doc_id = o.doc_id)"""
#: T9 on top: the whole text of products once more.
_T9 = f"""{_T10}, w AS ({sql_classified(TITLED, "doc_id, text", "text")}),
y AS (SELECT z.doc_id, title_label, z.label = 'product' AND w.f_alone AS alone, CASE WHEN alone THEN 'generic term alone' ELSE z.rule END AS rule, CASE WHEN alone THEN 'review' ELSE z.label END AS label, trim(coalesce(w.text, '')) = '' AS blank FROM z JOIN w ON z.doc_id = w.doc_id)"""
_PHASE = """CASE WHEN title_label = 'product' THEN 'title-download' WHEN title_label = 'not relevant' THEN 'title-skip' WHEN blank THEN 'inspect'
  WHEN label = 'product' THEN 'structured-download' WHEN label = 'not relevant' THEN 'structured-skip' ELSE 'inspect' END"""
_DOCUMENT = {"marker": MARKER, "stop_words": STOPS, "newline_only": True, "passed_over": ("heen",)}


@query("t10_document_classifier", f"WITH {_T10} SELECT doc_id, rule, section_id, array_to_string(notes, '; ') AS notes FROM z")
def t10_document(spark, sf):
    """The whole document classifier: strip, select the section, focus, classify, title veto."""
    got = C.classify_document(titled(spark, sf), "text", "title", CORPUS, **_DOCUMENT)
    return got.select("doc_id", "relevance.rule", "section_id", F.array_join("notes", "; ").alias("notes"))


@query("t9_structured_fields", f"WITH {_T9} SELECT doc_id, rule FROM y")
def t9(spark, sf):
    got = C.classify_structured(titled(spark, sf), "text", "title", CORPUS, **_DOCUMENT)
    return got.select("doc_id", "relevance.rule")


@query(
    "m11_reclassified_by_text",
    f"""WITH {_T10} SELECT z.doc_id, CASE WHEN toxic = 1 THEN 'manual' WHEN title_label <> 'review' THEN 'title' WHEN z.doc_id % 4 <> 0 AND d.text IS NOT NULL THEN 'text' ELSE 'needs document' END AS basis,
CASE basis WHEN 'title' THEN title_label WHEN 'text' THEN z.label ELSE CASE WHEN quality = 1 THEN 'product' ELSE 'not relevant' END END AS new_label,
basis = 'title' AND title_label = 'product' AND z.doc_id % 3 <> 0 AS to_download FROM z JOIN labels l ON z.doc_id = l.doc_id JOIN documents d ON z.doc_id = d.doc_id""",
)
def m11_by_text(spark, sf):
    """Labels of saved packets from their titles and saved texts; every fourth has no text, every third has files."""
    packets = titled(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "title", F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("saved"), F.when(F.col("toxic") == 1, "manual").otherwise("automatic").alias("source"), F.when(F.col("quality") == 1, "product").otherwise("not relevant").alias("stored")
    )
    got = C.reclassified_by_text(packets, "title", "source", "stored", "saved", F.col("doc_id") % 3 == 0, CORPUS, **_DOCUMENT)
    return got.select("doc_id", "basis", "new_label", "to_download")


@query(
    "t17_actions",
    f"""SELECT doc_id, label, CASE label WHEN 'product' THEN 'download' WHEN 'review' THEN 'inspect' ELSE 'skip' END AS action,
CASE label WHEN 'product' THEN 'product' WHEN 'review' THEN 'unclear' ELSE 'skip' END AS inspected FROM ({sql_classified()})""",
)
def t17(spark, sf):
    r = F.col("relevance")
    return _classified(spark, sf).select("doc_id", "label", C.title_action(r).alias("action"), C.inspection_outcome(r).alias("inspected"))


@query("t18_evidence_cascade", f"WITH {_T9} SELECT doc_id, {_PHASE} AS phase FROM y")
def t18(spark, sf):
    return C.cascade(titled(spark, sf), "title", "text", CORPUS, **_DOCUMENT).select("doc_id", "phase")


@query(
    "t19_scan_plan",
    f"""WITH t AS ({sql_classified(TITLED, "doc_id", "title")})
SELECT t.doc_id, CASE WHEN toxic = 1 THEN 'reuse' WHEN label = 'not relevant' THEN 'skip' WHEN quality = 1 THEN 'reuse' ELSE 'process' END AS plan
FROM t LEFT JOIN labels l ON t.doc_id = l.doc_id""",
)
def t19(spark, sf):
    docs = titled(spark, sf).select("doc_id", "title")
    state = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_manual"), (F.col("quality") == 1).alias("reusable"))
    return C.scan_plan(docs, state, "doc_id", "title", CORPUS).select("doc_id", "plan")


@query("t20_text_portion", "SELECT doc_id, length(p)::INT AS n, md5(p) AS digest FROM (SELECT doc_id, substr(string_split(text, ' that ')[1], 1, 4000) AS p FROM documents)")
def t20(spark, sf):
    p = C.portion(F.col("text"), " that ")
    return table(spark, sf, DOCS).select("doc_id", F.length(p).alias("n"), F.md5(p).alias("digest"))


@query("t21_usable_text", "SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) >= 200 AS usable FROM documents")
def t21(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", C.usable(F.col("text")).alias("usable"))


_PREFIXES = """(SELECT conv_id, turn, prefix, title, substr(string_split(prefix, ' that ')[1], 1, 4000) AS text FROM (
  SELECT conv_id, turn, string_agg(coalesce(text, ''), chr(10)) OVER w AS prefix, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) p
  JOIN (SELECT item_id, text AS title FROM benchmark) b ON p.conv_id % (SELECT count(*) FROM benchmark) = b.item_id WHERE rn <= 6)"""


@query(
    "t22_first_decisive_page",
    f"""WITH best AS (SELECT conv_id AS doc_id, turn, prefix, title, NULL AS section_id, false AS uncertain, {sql_stripped('text')} AS section FROM {_PREFIXES}),
f AS ({_FOCUS.replace("SELECT doc_id, title", "SELECT doc_id, turn, prefix, title")}), x AS ({sql_classified('f', 'doc_id, turn, prefix', 'focus')}), t AS ({sql_classified('f', 'doc_id, turn', 'title')}),
c AS (SELECT x.doc_id AS conv_id, x.turn, x.prefix, CASE WHEN t.label = 'not relevant' THEN t.label ELSE x.label END AS label FROM x JOIN t ON x.doc_id = t.doc_id AND x.turn = t.turn),
ok AS (SELECT * FROM c WHERE label <> 'review' AND length(regexp_replace(prefix, '\\s', '', 'g')) >= 40),
y AS (SELECT conv_id, min(turn) AS page, arg_min(label, turn) AS label FROM ok GROUP BY conv_id),
n AS (SELECT c.conv_id, count(*)::INT AS n_read FROM c LEFT JOIN y ON c.conv_id = y.conv_id WHERE c.turn <= coalesce(page, c.turn) GROUP BY 1)
SELECT n.conv_id, page, coalesce(label, 'review') AS label, n_read FROM n LEFT JOIN y ON n.conv_id = y.conv_id""",
)
def t22(spark, sf):
    titles = table(spark, sf, "benchmark").select(F.col("item_id").alias("__item"), F.col("text").alias("title"))
    pages = table(spark, sf, "conversations").join(titles, F.col("conv_id") % titles.count() == F.col("__item"))
    return progressive_decision(pages, "conv_id", "turn", "text", CORPUS, "title", marker=" that ", newline_only=True)


@query(
    "t23_review_without_documents",
    f"""WITH {_T9}, p AS (SELECT y.doc_id, {_PHASE} AS phase, source FROM y JOIN documents d ON y.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN phase = 'inspect' AND source IN ('src1', 'src2') THEN 'review' ELSE phase END AS phase,
  CASE WHEN phase = 'inspect' AND source IN ('src1', 'src2') THEN 'its documents are not public' END AS reason FROM p""",
)
def t23(spark, sf):
    portal = F.when(F.col("source").isin("src1", "src2"), "legacy").otherwise("current")
    got = C.cascade(titled(spark, sf), "title", "text", CORPUS, **_DOCUMENT)
    return got.select("doc_id", *C.review_without_documents(F.col("phase"), portal))
