"""Queries of requirement extraction over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import classify as C
from ..operators import extract as E
from ..operators import pattern_table as P
from ..operators import relational as Rel
from ..session import shared_path, table
from ..sources.store import KeyedStore
from .classify_queries import _PARTS, _q
from .registry import query

DOCS = "documents"
BUCKETS = (("night", "and|the"), ("tide", "tion|en"), ("of", "of|de"), ("rest", ""))
CUT = "(?i)( (and|or|of|the|de)|,|-)$"


def _bucket_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(R.bounded(p))}) THEN '{n}'" for n, p in BUCKETS[:-1]) + f" ELSE '{BUCKETS[-1][0]}' END"


_PIECES = f"""SELECT doc_id, source, list_filter(list_transform(flatten(list_transform({_PARTS}, lambda s: regexp_split_to_array(s, '\\s*[|]\\s*'))), lambda s: trim(regexp_replace(s, '(?i) ever.*$', '', 'g'))),
lambda s: length(s) >= 12 AND NOT regexp_matches(s, {_q(CUT)}) AND NOT length(s) - length(replace(s, '(', '')) > length(s) - length(replace(s, ')', ''))) AS parts FROM documents"""


def _pieces(spark, sf):
    parts = E.complete_sentences(C.sentences(F.col("text"), True), 12, CUT, r"\s*[|]\s*", "(?i) ever.*$")
    return table(spark, sf, DOCS).select("doc_id", "source", parts.alias("parts"))


@query("e6_unwrapped_lines")
def e6(spark, sf):
    """Lines joined in order within a text; the fold over lines has no SQL here."""
    return table(spark, sf, DOCS).select("doc_id", F.posexplode(E.unwrap_lines(F.col("text"))).alias("pos", "line"))


@query(
    "e7_text_line_items",
    """SELECT l_orderkey AS k, l_linenumber AS item_no, CASE WHEN l_suppkey % 3 = 0 THEN '2024-05-' || l_partkey END AS item_reference, 'Part ' || l_partkey || ' of ' || l_suppkey AS description, l_quantity AS quantity, 'lot' AS unit, l_extendedprice::DECIMAL(18,2) AS amount
FROM lineitem WHERE l_partkey % 7 > 0""",
)
def e7(spark, sf):
    item = F.col("l_linenumber").cast("string")
    described = F.when(F.col("l_partkey") % 7 == 0, "Signature of bidder").otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit("\n  of "), F.col("l_suppkey").cast("string")))
    total = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" lot "), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2))
    reference = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("2024-05-"), F.col("l_partkey").cast("string")))
    block = F.concat_ws("\n", reference, item, described, total)
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", block.alias("b"))
    notes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["b"]), "\n\n").alias("text"))
    return E.text_line_items(notes, "k", "text").select("k", "item_no", "item_reference", "description", "quantity", "unit", "amount")


RULES = (
    E.FieldRule("place", (r"\bin ([a-z]{8,})", r"\bof ([a-z]{8,})"), "e"),
    E.FieldRule("period", (r"([0-9]+@)",)),
    E.FieldRule("lang", (r"\n(Die|Les?|Las?|The) ",)),
)


@query(
    "e8_document_requirements",
    r"""WITH c AS (SELECT doc_id, source, lang, nullif(regexp_extract(text, '(^|[^A-Za-z0-9_])in ([a-z]{8,})', 2), '') AS p1, nullif(regexp_extract(text, '(^|[^A-Za-z0-9_])of ([a-z]{8,})', 2), '') AS p2,
nullif(regexp_extract(text, '([0-9]+@)', 1), '') AS period, nullif(regexp_extract(text, '\n(Die|Les?|Las?|The) ', 1), '') AS l FROM documents)
SELECT doc_id, coalesce(CASE WHEN contains(p1, 'e') THEN p1 END, CASE WHEN contains(p2, 'e') THEN p2 END) AS place, period, coalesce(l, lang) AS lang, CASE WHEN l IS NULL THEN 'notice' ELSE source END AS lang_source FROM c""",
)
def e8(spark, sf):
    edge = r"(?:^|[^A-Za-z0-9_])"
    rules = (E.FieldRule("place", (edge + "in ([a-z]{8,})", edge + "of ([a-z]{8,})"), "e"), *RULES[1:])
    got = E.document_requirements(table(spark, sf, DOCS), "doc_id", "text", "source", {"lang": "lang"}, rules)
    return got.select("doc_id", F.col("place.value").alias("place"), F.col("period.value").alias("period"), F.col("lang.value").alias("lang"), F.col("lang.source").alias("lang_source"))


@query(
    "e8_requirements_record",
    """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_custkey AS c FROM orders)
SELECT k, CASE WHEN k % 2 = 0 THEN 'Item ' || p ELSE p END AS product, CASE WHEN k % 2 = 0 THEN 'rfq' ELSE 'notice' END AS product_source, CASE WHEN k % 3 > 0 THEN 'C-' || k END AS control_number,
CASE WHEN k % 5 > 0 THEN c || '.00' ELSE c::VARCHAR END AS budget, CASE WHEN k % 5 > 0 THEN 'rfq' ELSE 'notice' END AS budget_source, CASE WHEN k % 4 = 0 THEN 'per lot' END AS awarding,
CASE WHEN k % 7 = 0 THEN 'within 30 days.' END AS payment_terms, 'Ana ' || c AS contact, CASE WHEN k % 2 = 0 THEN 'Business permit|' ELSE '' END || 'Income tax return' AS required_documents,
CASE WHEN k % 3 = 0 THEN 'training=Training of ' || c || ' users|' ELSE '' END || 'acceptance=Payment after inspection and acceptance' AS quotes,
CASE WHEN k % 4 = 1 THEN 'sealed envelope' END AS submission_method,
array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'control_number' END, 'deadline', 'place', CASE WHEN k % 6 <> 0 THEN 'delivery_period' END, CASE WHEN k % 4 > 0 THEN 'awarding' END, CASE WHEN k % 7 > 0 THEN 'payment_terms' END], lambda x: x IS NOT NULL), ',') AS missing
FROM o""",
)
def e8_record(spark, sf):
    """The whole record of texts in which fields come and go."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    said = lambda n, r, *parts: F.when(k % n == r, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))
    text = F.concat_ws(
        "\n", said(2, 0, 'The office intends to procure "Item ', F.col("o_orderpriority"), '"'), F.when(k % 3 > 0, F.concat(F.lit("CONTROL NO. : C-"), k.cast("string"))),
        F.when(k % 5 > 0, F.concat(F.lit("Approved Budget for the contract (PHP "), c, F.lit(".00)"))), said(6, 0, "Delivery schedule: ", c, " days"), said(4, 0, "AWARDING: per lot"),
        said(7, 0, "Payment terms:\nwithin 30 days. Not a term."), F.concat(F.lit("Attention: Ana "), c, F.lit(", head")), said(2, 0, "1. Business permit"), F.lit("2. Permit with printed name\n3) Income tax  return\n4. A chair"),
        said(3, 0, "Training of ", c, " users"), F.lit("Payment after inspection and acceptance"), said(4, 1, "In a sealed envelope"),
    )
    docs = table(spark, sf, "orders").withColumns({"text": text, "file": F.lit("rfq"), "listed": c})
    got = E.requirements_record(docs, "o_orderkey", "text", "file", C.sentences(F.col("text"), True), {"product": "o_orderpriority", "budget": "listed"})
    quotes = F.array_join(F.transform("quotes", lambda x: F.concat(x["name"], F.lit("="), x["quote"])), "|")
    return got.select(
        k.alias("k"), F.col("product.value").alias("product"), F.col("product.source").alias("product_source"), F.col("control_number.value").alias("control_number"), F.col("budget.value").alias("budget"),
        F.col("budget.source").alias("budget_source"), F.col("awarding.value").alias("awarding"), F.col("payment_terms.value").alias("payment_terms"), F.col("contact.value").alias("contact"),
        F.array_join("required_documents", "|").alias("required_documents"), quotes.alias("quotes"), "submission_method", F.array_join("missing_fields", ",").alias("missing"),
    )


@query(
    "e10_delivery_period",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || ' calendar days' WHEN 1 THEN '7 Days' WHEN 2 THEN o_custkey::VARCHAR ELSE '45' END AS value,
CASE WHEN o_orderkey % 4 < 2 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN o_orderkey % 4 IN (1, 3) THEN 'notice' ELSE 'rfq' END AS source FROM orders""",
)
def e10(spark, sf):
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Delivery period: "), n, F.lit(" calendar days"))).when(k == 2, F.concat(F.lit("Delivery Time : "), n)).otherwise("none")
    structured = F.when(k == 1, "7 Days").when(k == 3, "45")
    f = E.delivery_period(text, structured, F.lit("rfq"))
    return table(spark, sf, "orders").select("o_orderkey", f["value"].alias("value"), f["confidence"].alias("confidence"), f["source"].alias("source"))


@query("e11_solicitation_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'RFQ-' || o_orderkey || '-A' END AS number FROM orders")
def e11(spark, sf):
    n = F.concat(F.lit("RFQ-"), F.col("o_orderkey").cast("string"), F.lit("-A"))
    control = F.when(F.col("o_orderkey") % 3 == 0, n)
    return table(spark, sf, "orders").select("o_orderkey", E.solicitation_number(F.concat(F.lit("RFQ No.: "), n, F.lit(" Date 1 Jan")), control).alias("number"))


@query("e12_complete_sentences", f"SELECT doc_id, len(parts)::INT AS n, md5(array_to_string(parts, '|')) AS digest FROM ({_PIECES})")
def e12(spark, sf):
    return _pieces(spark, sf).select("doc_id", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|")).alias("digest"))


@query("e13_buckets", f"SELECT bucket, count(*)::BIGINT AS n FROM (SELECT {_bucket_sql('s')} AS bucket FROM (SELECT unnest(parts) AS s FROM ({_PIECES}))) GROUP BY 1")
def e13(spark, sf):
    s = _pieces(spark, sf).select(F.explode("parts").alias("s"))
    return s.groupBy(E.bucket_of(F.col("s"), BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))


_CLAUSES = f"""SELECT doc_id, source, pos, clause, {_bucket_sql('clause')} AS bucket FROM (
  SELECT *, lead(low) OVER (PARTITION BY doc_id ORDER BY low) AS next FROM (
    SELECT doc_id, source, pos, clause, lower(clause) AS low, row_number() OVER (PARTITION BY doc_id, lower(clause) ORDER BY pos) AS rn
    FROM (SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS clause FROM ({_PIECES}))) WHERE rn = 1)
WHERE next IS NULL OR NOT starts_with(next, low)"""


@query("e14_clauses", f"SELECT doc_id, pos::INT AS pos, bucket, md5(clause) AS digest FROM ({_CLAUSES})")
def e14(spark, sf):
    return E.clauses(_pieces(spark, sf), "doc_id", "parts", BUCKETS).select("doc_id", "pos", "bucket", F.md5("clause").alias("digest"))


_RUN = (("first", r"heen"), ("second", r"las?|der"))


@query(
    "e14_deployment",
    f"""SELECT doc_id, CASE WHEN a AND NOT b THEN 'first' WHEN b AND NOT a THEN 'second' END AS deployment, CASE WHEN a <> b THEN source END AS source
FROM (SELECT doc_id, source, regexp_matches(text, {_q(R.bounded(_RUN[0][1]))}) AS a, regexp_matches(text, {_q(R.bounded(_RUN[1][1]))}) AS b FROM documents)""",
)
def e14_deployment(spark, sf):
    """One of two wordings, where the other doesn't occur."""
    got = table(spark, sf, DOCS).select("doc_id", E.deployment(F.col("text"), F.col("source"), _RUN).alias("d"))
    return got.select("doc_id", F.col("d.value").alias("deployment"), F.col("d.source").alias("source"))


@query(
    "e15_template_items",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'licenses' ELSE 'subscription' END AS template, p_size AS quantity, CASE WHEN p_size % 3 = 0 THEN NULL ELSE '2 years' END AS duration FROM part WHERE p_size > 0",
)
def e15(spark, sf):
    n = F.col("p_size").cast("string")
    text = F.concat(n, F.when(F.col("p_size") % 2 == 0, " user licenses").otherwise(" annual subscriptions"), F.when(F.col("p_size") % 3 == 0, "").otherwise(" for 2 years"))
    parts = table(spark, sf, "part").filter("p_size > 0").withColumn("text", text)
    templates = (
        E.ItemTemplate("licenses", r"(?i)([0-9]+)\s+(?:user\s+)?licenses?(?:\s+for\s+([0-9]+\s+(?:year|month)s?))?", "license", "per user"),
        E.TEMPLATES[1],
    )
    return E.template_items(parts, "p_partkey", "text", templates).select("p_partkey", "template", "quantity", "duration")


_AFTER = r"(?i)(?:^|[^a-z0-9_]){}\s+([a-z]+)"


@query(
    "e15_table_templates",
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS w FROM benchmark),
h AS (SELECT doc_id, w, regexp_extract_all(text, replace('{_AFTER}', '{{}}', w)) AS q FROM documents JOIN w ON contains(lower(text), w))
SELECT doc_id, w AS template, len(q)::INT AS n, md5(array_to_string(q, '|')) AS digest FROM h WHERE len(q) > 0""",
)
def e15_table(spark, sf):
    """Some hundreds of templates, one for each longer word of the benchmark, in one pass over documents."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct()
    templates = words.select(F.lit("items").alias("rule_set"), F.lit(1).alias("step"), F.col("w").alias("label"), F.replace(F.lit(_AFTER), F.lit("{}"), F.col("w")).alias("pattern"), F.col("w").alias("anchor"))
    hits = P.pattern_hits(table(spark, sf, DOCS), "doc_id", "text", P.pattern_rows(templates))
    quotes = F.transform(F.sort_array(F.collect_list(F.struct("pos", "quote"))), lambda x: x["quote"])
    return hits.groupBy("doc_id", F.col("label").alias("template")).agg(F.count("*").cast("int").alias("n"), F.md5(F.array_join(quotes, "|")).alias("digest"))


@query(
    "e16_structured_items",
    """WITH t AS (SELECT l_orderkey, 'text item' AS description, l_quantity AS quantity, 'lot' AS unit, NULL::DOUBLE AS licenses FROM lineitem WHERE l_orderkey % 3 = 0 AND l_returnflag = 'R'),
s AS (SELECT l_orderkey, 'Part ' || l_partkey AS description, l_quantity AS quantity, CASE WHEN l_linestatus = 'F' THEN 'License' ELSE 'lot' END AS unit, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS licenses FROM lineitem WHERE l_returnflag <> 'N')
SELECT * FROM t UNION ALL SELECT * FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM t)""",
)
def e16(spark, sf):
    li = table(spark, sf, "lineitem")
    lots = li.withColumn("name", F.when(F.col("l_returnflag") == "N", F.lit("Lot 1")).otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")))).withColumn("unit", F.when(F.col("l_linestatus") == "F", "License").otherwise("lot"))
    structured = E.structured_items(lots, "l_orderkey", "name", "l_quantity", "unit")
    text = li.filter("l_orderkey % 3 = 0 AND l_returnflag = 'R'").select("l_orderkey", F.lit("text item").alias("description"), F.col("l_quantity").alias("quantity"), F.lit("lot").alias("unit"), F.lit(None).cast("double").alias("licenses"))
    return E.merged_items(text, structured, "l_orderkey")


@query(
    "e17_budget_reconciliation",
    """WITH l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE sum(l_extendedprice)::DECIMAL(18,2) END AS v FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN l.v ELSE o_totalprice::DECIMAL(18,2) END AS a, l.v AS b FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, coalesce(a, b) AS value, CASE WHEN a IS NULL THEN 'items' ELSE 'notice' END AS from_source, CASE WHEN a IS NULL OR b IS NULL THEN 'single' WHEN a = b THEN 'corroborated' ELSE 'conflicting' END AS scope,
a IS NOT NULL AND b IS NOT NULL AND a <> b AS needs_review FROM b WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def e17(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("v"))
    items = items.withColumn("v", F.when(F.col("l_orderkey") % 2 != 0, F.col("v")))
    o = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    a = F.when(F.col("o_orderkey") % 5 == 1, F.col("v")).otherwise(F.col("o_totalprice").cast("decimal(18,2)"))
    both = o.select("o_orderkey", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit("notice").alias("source"), a.alias("value")), F.struct(F.lit(1).alias("rank"), F.lit("items").alias("source"), F.col("v").alias("value")))).alias("c"))
    return E.reconciled(both.select("o_orderkey", "c.*"), "o_orderkey", "value", "rank", "source").select("o_orderkey", "value", "from_source", "scope", "needs_review")


ORDER = ["tide", "of", "night", "rest"]


@query(
    "e18_once_across_buckets",
    f"""WITH c AS ({_CLAUSES}), r AS (SELECT source, bucket, clause, row_number() OVER (PARTITION BY source, lower(clause) ORDER BY list_position(['tide', 'of', 'night', 'rest'], bucket), doc_id, pos) AS rn FROM c)
SELECT source, bucket, count(*)::BIGINT AS n FROM r WHERE rn = 1 GROUP BY 1, 2""",
)
def e18(spark, sf):
    docs = _pieces(spark, sf)
    c = E.clauses(docs, "doc_id", "parts", BUCKETS).join(docs.select("doc_id", "source"), "doc_id").withColumn("source_order", F.col("doc_id"))
    return E.once_across_buckets(c, "source", ORDER).groupBy("source", "bucket").agg(F.count("*").alias("n"))


@query(
    "e20_technical_summary",
    f"""WITH c AS ({_CLAUSES}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['tide', 'of', 'night', 'rest'], bucket), pos) AS place FROM c)
SELECT doc_id, count(*)::INT AS n_clauses, md5(string_agg(bucket || ':' || clause, '|' ORDER BY place)) AS digest, 'Document 01: ' || any_value(source) AS documents, any_value(CASE WHEN doc_id % 2 = 0 THEN 'License type: per user' ELSE '' END) AS facts FROM k GROUP BY 1""",
)
def e20(spark, sf):
    docs = _pieces(spark, sf)
    c = E.clauses(docs, "doc_id", "parts", BUCKETS).join(docs.select("doc_id", "source"), "doc_id").withColumn("source_order", F.lit(0))
    items = docs.select("doc_id", F.lit(0).alias("pos"), F.when(F.col("doc_id") % 2 == 0, "per user").alias("license_type"), F.lit(None).cast("string").alias("duration"))
    s = E.technical_summary(items, c, "doc_id", ORDER)
    text = F.array_join(F.transform("clauses", lambda x: F.concat(x["bucket"], F.lit(":"), x["clause"])), "|")
    return s.select("doc_id", F.size("clauses").alias("n_clauses"), F.md5(text).alias("digest"), F.array_join("documents", ",").alias("documents"), F.array_join("facts", ",").alias("facts"))


_FACTS = """(WITH i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m, l_partkey,
    CASE WHEN l_returnflag = 'R' THEN 'per user' END AS kind, CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN l_quantity::INT || ' months' END AS months FROM lineitem),
x AS (SELECT k, 2 * n AS ord, 'License type' || CASE WHEN m > 1 THEN ' ' || n ELSE '' END AS label, kind AS value, 'Part ' || l_partkey || '.pdf' AS source FROM i WHERE kind IS NOT NULL
UNION ALL SELECT k, 2 * n + 1, 'Duration' || CASE WHEN m > 1 THEN ' ' || n ELSE '' END, months, 'notice' FROM i WHERE months IS NOT NULL
UNION ALL SELECT o_orderkey, 1000000, 'Duration', '30 days', 'TOR.pdf' FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT k FROM i WHERE months IS NOT NULL)
UNION ALL SELECT o_orderkey, 1000001, 'Deployment', 'cloud', CASE WHEN o_orderkey % 8 = 0 THEN 'elsewhere.pdf' END FROM orders WHERE o_orderkey % 4 = 0)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY ord) AS place, label, value, source FROM x)"""


def _facts(spark, sf):
    """Facts of orders: license types of returned lines, durations of some, a delivery time and a deployment of some orders."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    record = lambda value, source: F.struct(value.alias("value"), source.alias("source"))
    months = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 0), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" months")))
    items = li.select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"), record(F.when(F.col("l_returnflag") == "R", " per user "), F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(".pdf"))).alias("kind"), record(months, F.lit("notice")).alias("months"))
    notices = o.select(
        F.col("o_orderkey").alias("k"), record(F.when(F.col("o_orderstatus") == "O", "30 days"), F.lit("TOR.pdf")).alias("delivery"),
        record(F.when(F.col("o_orderkey") % 4 == 0, "cloud"), F.when(F.col("o_orderkey") % 8 == 0, "elsewhere.pdf")).alias("deployment"),
    )
    return E.summary_facts(items, notices, "k", "pos", "kind", "months", "delivery", "deployment")


@query(
    "e20_cited_facts",
    f"""WITH f AS {_FACTS}, s AS (SELECT o_orderkey AS k, 0 AS tier, 0 AS pos, 'RFQ.pdf' AS name FROM orders UNION ALL SELECT k, 2, place, source FROM f WHERE source NOT IN ('notice', 'elsewhere.pdf') UNION ALL SELECT o_orderkey, 3, 0, 'TOR.pdf' FROM orders WHERE o_orderkey % 3 = 0),
d AS (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY min((tier, pos)), name) AS number FROM s GROUP BY 1, 2)
SELECT f.k, place::INT AS place, label, value, CASE WHEN source IS NULL THEN NULL WHEN source = 'notice' THEN 'Notice' WHEN number IS NULL THEN 'Source document' ELSE 'Document ' || lpad(number::VARCHAR, 2, '0') END AS source_label
FROM f LEFT JOIN d ON f.k = d.k AND f.source = d.name""",
)
def e20_cited(spark, sf):
    """Facts with the numbers of the documents that they cite; one document is cited and not listed."""
    f = _facts(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    named = o.select("k", F.lit(0).alias("tier"), F.lit(0).alias("pos"), F.lit("RFQ.pdf").alias("name")).union(f.filter("source <> 'elsewhere.pdf'").select("k", F.lit(2), "place", "source")).union(o.filter("k % 3 = 0").select("k", F.lit(3), F.lit(0), F.lit("TOR.pdf")))
    documents = E.source_documents(named, "k", "tier", "pos", "name")
    return E.cited(f, documents, "k").select("k", "place", "label", "value", "source_label")


@query(
    "p11_whole_report",
    f"""WITH f AS {_FACTS}, x AS (SELECT k, string_agg(label || '=' || value || '@' || CASE WHEN source IS NULL THEN '-' WHEN source = 'notice' THEN 'Notice' ELSE 'Source document' END, '|' ORDER BY place) AS facts FROM f GROUP BY 1),
i AS (SELECT l_orderkey AS k, string_agg(coalesce(CASE WHEN l_returnflag = 'R' THEN 'per user/high' END, '-') || ':' || CASE WHEN l_partkey % 5 = 0 THEN '-' ELSE l_quantity::INT || '/not recorded' END, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS items FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_orderkey, c_name AS organization, coalesce(items, '') AS items, coalesce(facts, '') AS facts, CASE WHEN o_orderkey % 2 = 0 THEN 'RFQ.pdf' ELSE '' END AS documents, CASE WHEN o_orderkey % 7 = 0 THEN 'budget=1' ELSE '' END AS conflicts,
coalesce(c.n, 0)::BIGINT AS n_clauses, CASE WHEN o_orderkey % 3 = 0 THEN 'a@b' ELSE '' END AS emails, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS reviewed, items IS NOT NULL OR facts IS NOT NULL OR c.n IS NOT NULL AS has_requirements
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN i ON o_orderkey = i.k LEFT JOIN x ON o_orderkey = x.k LEFT JOIN c ON o_orderkey = c.k""",
)
def p11_whole(spark, sf):
    """Whole reports of orders: records of items with and without a source, facts, documents, conflicts, clauses."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    kind = F.struct(F.when(F.col("l_returnflag") == "R", "per user").alias("value"), F.lit("notice").alias("source"), F.lit("high").alias("confidence"))
    keys = o.select("o_orderkey")
    facts = E.cited(_facts(spark, sf).withColumnRenamed("k", "o_orderkey"), keys.select("o_orderkey", F.lit(1).alias("number"), F.lit("none.pdf").alias("name")), "o_orderkey")
    documents = keys.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit(1).alias("number"), F.lit("RFQ.pdf").alias("name"))
    conflicts = keys.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("budget").alias("field"), F.lit("1").alias("value"), F.lit("notice").alias("source"))
    emails = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a@b"))).otherwise(F.array().cast("array<string>"))
    reviewed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    amount = F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity").cast("int"))
    got = Rel.whole_case_report(o, "o_orderkey", {"organization": F.col("c_name")}, {}, reviewed, li.filter("l_returnflag <> 'N'"), "at", {"kind": kind, "quantity": amount}, facts, documents, conflicts, li.filter("l_returnflag = 'A'"), emails)
    said = lambda x: F.coalesce(F.concat(x["value"], F.lit("/"), x["confidence"]), F.lit("-"))
    return got.select(
        "o_orderkey", "organization", F.array_join(F.transform("items", lambda x: F.concat(said(x["kind"]), F.lit(":"), said(x["quantity"]))), "|").alias("items"),
        F.array_join(F.transform("facts", lambda x: F.concat(x["label"], F.lit("="), x["value"], F.lit("@"), F.coalesce(x["source_label"], F.lit("-")))), "|").alias("facts"),
        F.array_join(F.transform("documents", lambda x: x["name"]), "|").alias("documents"), F.array_join(F.transform("conflicts", lambda x: F.concat(x["field"], F.lit("="), x["value"])), "|").alias("conflicts"),
        "n_clauses", F.array_join("email_candidates", "|").alias("emails"), "reviewed", "has_requirements",
    )


@query(
    "e20_document_links",
    r"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey::VARCHAR AS p FROM lineitem),
d AS (SELECT DISTINCT k, 'Part ' || p || '.pdf' AS name FROM l),
f AS (SELECT k, CASE n % 4 WHEN 0 THEN 'Part ' || p || '.pdf' WHEN 1 THEN 'PART__' || p || '.pdf' WHEN 2 THEN 'part-' || p || '.docx' ELSE 'other ' || p || '.pdf' END AS filename, 'u/' || n AS url FROM l
  UNION ALL SELECT k, ' PART ' || p || '.txt', 'v/' || n FROM l WHERE n % 3 = 0),
g AS (SELECT *, trim(regexp_replace(lower(filename), '[\s_-]+', ' ', 'g')) AS plain FROM f),
e AS (SELECT *, trim(regexp_replace(lower(name), '[\s_-]+', ' ', 'g')) AS plain FROM d),
m AS (SELECT e.k, name, count(DISTINCT url) FILTER (filename = name) AS n1, min(url) FILTER (filename = name) AS u1, count(DISTINCT url) FILTER (g.plain = e.plain) AS n2, min(url) FILTER (g.plain = e.plain) AS u2, count(DISTINCT url) AS n3, min(url) AS u3
  FROM e LEFT JOIN g ON e.k = g.k AND regexp_replace(g.plain, '\.[a-z0-9]{1,8}$', '') = regexp_replace(e.plain, '\.[a-z0-9]{1,8}$', '') GROUP BY 1, 2),
r AS (SELECT k, name, CASE WHEN n1 > 0 THEN 'exact' WHEN n2 > 0 THEN 'plain' WHEN n3 > 0 THEN 'stem' END AS tier, CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS n, CASE WHEN n1 > 0 THEN u1 WHEN n2 > 0 THEN u2 ELSE u3 END AS u FROM m)
SELECT k, name, CASE WHEN o_orderstatus <> 'P' AND k % 10 < 9 THEN tier END AS tier, CASE WHEN o_orderstatus <> 'P' AND k % 10 < 9 AND n = 1 THEN u END AS href,
CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN k % 10 = 9 THEN 'checking' WHEN n = 0 THEN 'unavailable' WHEN n = 1 THEN 'available' ELSE 'ambiguous' END AS status FROM r JOIN orders ON k = o_orderkey""",
)
def e20_links(spark, sf):
    """Names of parts resolved to files that are called like them, nearly like them, or like nothing else."""
    p = F.col("l_partkey").cast("string")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), p.alias("p"))
    part = F.concat(F.lit("Part "), F.col("p"), F.lit(".pdf"))
    n = F.col("n") % 4
    called = F.when(n == 0, part).when(n == 1, F.concat(F.lit("PART__"), F.col("p"), F.lit(".pdf"))).when(n == 2, F.concat(F.lit("part-"), F.col("p"), F.lit(".docx"))).otherwise(F.concat(F.lit("other "), F.col("p"), F.lit(".pdf")))
    files = li.select("k", called.alias("filename"), F.concat(F.lit("u/"), F.col("n").cast("string")).alias("url"))
    files = files.union(li.filter("n % 3 = 0").select("k", F.concat(F.lit(" PART "), F.col("p"), F.lit(".txt")), F.concat(F.lit("v/"), F.col("n").cast("string"))))
    state = F.when(F.col("o_orderstatus") == "P", "error").when(F.col("o_orderkey") % 10 < 9, "ready")
    return E.document_links(li.select("k", part.alias("name")), files, table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), state.alias("state")), "k")


@query(
    "e22_wordings",
    r"""WITH f AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM documents), h AS (SELECT *, regexp_extract(flat, '[A-Za-z]+ed under') AS hit FROM f), p AS (SELECT *, instr(flat, hit) AS p0 FROM h WHERE hit <> '')
SELECT doc_id, trim(substr(flat, greatest(p0 - 80, 1), p0 + length(hit) + 80 - greatest(p0 - 80, 1))) AS wording FROM p""",
)
def e22(spark, sf):
    return table(spark, sf, DOCS).select("doc_id", E.wording_around(F.col("text"), "[A-Za-z]+ed under").alias("wording")).filter("wording IS NOT NULL")


@query(
    "e22_submission_methods",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'send your quote by email to a' || o_custkey || '@x' WHEN 1 THEN 'courier' WHEN 2 THEN 'hand carried' END AS method FROM orders""",
)
def e22_methods(spark, sf):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("By courier, or send  your quote by email to a"), c, F.lit("@x. Thanks"))).when(k == 1, "Quotes by COURIER or sealed envelope").when(k == 2, "They are hand  carried").otherwise("couriers write e-mails")
    return table(spark, sf, "orders").select("o_orderkey", E.submission_method(F.regexp_replace(text, " +", " ")).alias("method"))


@query("e22_identity", "SELECT c_custkey, c_name AS agency, nullif(c_mktsegment, 'BUILDING') AS category, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'notice' END AS category_source FROM customer")
def e22_identity(spark, sf):
    c = table(spark, sf, "customer").withColumn("segment", F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")))
    got = E.identity_fields(c, "c_custkey", {"agency": "c_name", "category": "segment"})
    return got.select("c_custkey", F.col("agency.value").alias("agency"), F.col("category.value").alias("category"), F.col("category.source").alias("category_source"))


@query(
    "e23_bulk_requirements",
    f"""WITH f AS (SELECT d.doc_id, nullif(regexp_extract(text, '([0-9]+@)', 1), '') AS period, coalesce(nullif(regexp_extract(text, '\\n(Die|Les?|Las?|The) ', 1), ''), lang) AS lang
  FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(bucket || ':' || clause, '|' ORDER BY lower(clause))) AS digest FROM ({_CLAUSES}) GROUP BY 1)
SELECT f.doc_id, period, lang, coalesce(n, 0)::INT AS n_clauses, coalesce(digest, md5('')) AS digest, concat_ws(',', CASE WHEN period IS NULL THEN 'period' END, CASE WHEN lang IS NULL THEN 'lang' END) AS missing FROM f LEFT JOIN c ON f.doc_id = c.doc_id""",
)
def e23(spark, sf):
    """Records of the documents of chosen notices, with their clauses and what is missing."""
    chosen = table(spark, sf, "labels").filter("quality = 1")
    parts = E.complete_sentences(C.sentences(F.col("text"), True), 12, CUT, r"\s*[|]\s*", "(?i) ever.*$")
    got = E.bulk_requirements(table(spark, sf, DOCS), chosen, "doc_id", text_col="text", source_col="source", parts=parts, notice={"lang": "lang"}, rules=RULES[1:], buckets=BUCKETS, quoted=(("to", "to"),))
    text = F.array_join(F.transform("clauses", lambda x: F.concat(x["bucket"], F.lit(":"), x["clause"])), "|")
    return got.select("doc_id", F.col("period.value").alias("period"), F.col("lang.value").alias("lang"), F.size("clauses").alias("n_clauses"), F.md5(text).alias("digest"), F.array_join("missing_fields", ",").alias("missing"))


_BUDGETED = """(SELECT doc_id, text, source, CASE doc_id % 4 WHEN 0 THEN o_totalprice::DECIMAL(18,2) WHEN 1 THEN o_totalprice::DECIMAL(18,2) + 1 END AS said, CASE WHEN doc_id % 5 > 0 THEN o_totalprice::DECIMAL(18,2) END AS listed, doc_id % 3 = 0 AS due
  FROM documents JOIN orders ON doc_id = o_orderkey WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""


@query(
    "e23_full_records",
    f"""WITH b AS {_BUDGETED}, i AS (SELECT l_orderkey, count(*)::INT AS n, bool_or(l_linestatus = 'O' AND l_returnflag = 'R') AS gap, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS licenses FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT b.doc_id, coalesce(said, listed) AS budget, CASE WHEN said IS NOT NULL THEN source WHEN listed IS NOT NULL THEN 'notice' END AS budget_source, CASE WHEN said IS NULL AND listed IS NULL THEN NULL WHEN said IS NULL OR listed IS NULL THEN 'single' WHEN said = listed THEN 'corroborated' ELSE 'conflicting' END AS scope,
coalesce(n, 0)::INT AS n_items, licenses, CASE WHEN due THEN '7 May 2026' END AS deadline,
CASE WHEN coalesce(said <> listed, false) THEN 'needs_review' WHEN coalesce(said, listed) IS NULL OR coalesce(n, 0) = 0 OR NOT due OR coalesce(gap, false) THEN 'partial' ELSE 'complete' END AS status,
concat_ws(',', CASE WHEN coalesce(said, listed) IS NULL THEN 'budget' END, CASE WHEN coalesce(n, 0) = 0 THEN 'items' END, CASE WHEN NOT due THEN 'deadline' END) AS missing
FROM b LEFT JOIN i ON b.doc_id = l_orderkey""",
)
def e23_full(spark, sf):
    """Whole records of chosen documents, with items of the order of that number, two sources of the budget and a status; written to a store and read."""
    chosen = table(spark, sf, "labels").filter("quality = 1")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.col("price")).when(k == 1, F.col("price") + 1)
    tail = F.concat(F.coalesce(F.concat(F.lit("\nApproved budget: PHP "), F.format_number(said, 2)), F.lit("")), F.when(F.col("doc_id") % 3 == 0, "\nDeadline of submission: 7 May 2026\n").otherwise("\n"))
    docs = table(spark, sf, DOCS).join(o, "doc_id").withColumns({"full": F.concat("text", tail), "listed": F.when(F.col("doc_id") % 5 > 0, F.col("price"))})
    li = table(spark, sf, "lineitem").filter("l_returnflag <> 'N'")
    gap = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")
    lots = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("name"), F.when(~gap, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_linestatus") == "F", "License").otherwise("lot").alias("unit"))
    items = E.structured_items(lots, "doc_id", "name", "quantity", "unit")
    parts = E.complete_sentences(C.sentences(F.col("full"), True), 12, CUT, r"\s*[|]\s*", "(?i) ever.*$")
    got = E.full_records(E.bulk_requirements(docs, chosen, "doc_id", text_col="full", source_col="source", parts=parts, notice={}, rules=(E.DEADLINE, E.RECORD[3]), buckets=BUCKETS), items, docs.select("doc_id", "listed"), "doc_id", "budget", "listed", {"deadline": "deadline"})
    path = shared_path(spark, "requirements-store")
    KeyedStore.create(spark, path, got.schema, "doc_id", 16).upsert(got, lambda current, incoming: incoming, "job", 0)
    rows = KeyedStore(spark, path).read()
    return rows.select(
        "doc_id", F.col("budget.value").alias("budget"), F.col("budget.from_source").alias("budget_source"), F.col("budget.scope").alias("scope"), F.size("items").alias("n_items"),
        F.aggregate("items", F.lit(None).cast("double"), lambda acc, x: F.coalesce(acc + x["licenses"], acc, x["licenses"])).alias("licenses"), F.col("record.deadline.value").alias("deadline"), "status", F.array_join("missing_fields", ",").alias("missing"),
    )
