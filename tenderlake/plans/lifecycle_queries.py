"""Queries of keyed state over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import format_money
from ..functions.text import party_name
from ..operators import classify as C
from ..operators import lifecycle as L
from ..operators import relational as R
from ..session import table
from .classify_queries import CORPUS, DOCS, TITLED, sql_classified, titled
from .registry import query


def _events(spark, sf):
    return table(spark, sf, "events")


@query(
    "m1_manual_decisions",
    """WITH v AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'product' WHEN 'error' THEN 'not relevant' WHEN 'view' THEN 'review' END AS d FROM events)
SELECT user_id, arg_max(d, (ts, event_id)) AS decision, max(ts) AS decided_at, count(*)::BIGINT AS n_decisions FROM v WHERE d IS NOT NULL GROUP BY 1""",
)
def m1(spark, sf):
    spelled = F.when(F.col("event_type") == "click", " Software").when(F.col("event_type") == "error", "NOT_relevant").when(F.col("event_type") == "view", "unsure").otherwise("?")
    return L.decisions(_events(spark, sf).withColumn("value_text", spelled), "user_id", "value_text", "ts", "event_id")


@query(
    "m1_applied_decisions",
    """WITH v AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'product' WHEN 'error' THEN 'not relevant' WHEN 'view' THEN 'review' END AS d FROM events),
m AS (SELECT user_id, arg_max(d, (ts, event_id)) AS d, max(ts) AS decided_at FROM v WHERE d IS NOT NULL GROUP BY 1)
SELECT c_custkey, coalesce(d, 'review') AS label, CASE WHEN d IS NULL THEN false ELSE d = 'product' END AS is_relevant, CASE WHEN d IS NULL THEN true ELSE d = 'review' END AS needs_review,
CASE d WHEN 'product' THEN 'product' WHEN 'not relevant' THEN 'goods' WHEN 'review' THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE 'mixed' END ELSE CASE WHEN c_mktsegment = 'BUILDING' THEN 'goods' ELSE 'mixed' END END AS category,
CASE d WHEN 'product' THEN 'terms; a person marked this as a product' WHEN 'not relevant' THEN 'terms; a person marked this as not relevant' WHEN 'review' THEN 'terms; a person kept this for review' ELSE 'terms; a person kept this for review' END AS reasons,
CASE WHEN d IS NULL THEN 'automatic' ELSE 'manual' END AS source, coalesce(decided_at, TIMESTAMP '2020-01-01') AS reviewed_at, CASE WHEN c_custkey % 3 = 0 THEN 'done' WHEN d = 'product' THEN 'new' END AS work_status
FROM customer LEFT JOIN m ON c_custkey = user_id""",
)
def m1_applied(spark, sf):
    """Packets of customers with the decisions of their users."""
    spelled = F.when(F.col("event_type") == "click", " Software").when(F.col("event_type") == "error", "NOT_relevant").when(F.col("event_type") == "view", "unsure").otherwise("?")
    made = L.decisions(_events(spark, sf).withColumn("value_text", spelled), "user_id", "value_text", "ts", "event_id").withColumnRenamed("user_id", "c_custkey")
    packets = table(spark, sf, "customer").select(
        "c_custkey", F.lit("review").alias("label"), F.lit(False).alias("is_relevant"), F.lit(True).alias("needs_review"), F.when(F.col("c_mktsegment") == "BUILDING", "goods").otherwise("mixed").alias("category"),
        F.array(F.lit("terms"), F.lit(L.DECIDED["review"])).alias("reasons"), F.lit("automatic").alias("source"), F.lit("2020-01-01").cast("timestamp_ntz").alias("reviewed_at"), F.when(F.col("c_custkey") % 3 == 0, "done").alias("work_status"),
    )
    return L.applied_decisions(packets, made, "c_custkey").withColumn("reasons", F.array_join("reasons", "; "))


@query(
    "m2_manual_over_automatic",
    f"SELECT c.doc_id, CASE WHEN toxic = 1 THEN 'not relevant' ELSE label END AS label, CASE WHEN toxic = 1 THEN 'manual' ELSE 'automatic' END AS source FROM ({sql_classified()}) c LEFT JOIN labels l ON c.doc_id = l.doc_id",
)
def m2(spark, sf):
    auto = C.classify(table(spark, sf, DOCS), "text", CORPUS).select("doc_id", C.label(F.col("relevance")).alias("label"))
    manual = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "not relevant").alias("label"))
    return L.manual_over_automatic(auto, manual, "doc_id", "label")


@query(
    "m3_work_status",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in-progress' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' END END AS status FROM orders",
)
def m3(spark, sf):
    stored = F.when(F.col("o_orderstatus") == "F", " Finished").when(F.col("o_orderstatus") == "P", "in progress").otherwise("?")
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "product").otherwise("review")
    return table(spark, sf, "orders").select("o_orderkey", L.work_status(stored, label).alias("status"))


@query("m4_first_review", "SELECT user_id, min(ts) FILTER (WHERE event_type = 'purchase' AND value > 20) AS reviewed_at, min(ts) FILTER (WHERE event_type = 'purchase' AND value > 20) IS NULL AS pending FROM events GROUP BY 1")
def m4(spark, sf):
    return L.first_review(_events(spark, sf), "user_id", "ts", (F.col("event_type") == "purchase") & (F.col("value") > 20))


@query(
    "m5_read_repair",
    """WITH n AS (SELECT user_id, min(ts) AS appeared FROM events WHERE user_id % 7 > 0 AND value > 25 GROUP BY 1), r AS (SELECT user_id, min(ts) AS r FROM events WHERE event_type = 'view' AND value > 28 GROUP BY 1),
k AS (SELECT n.user_id, CASE WHEN appeared <= TIMESTAMP '2024-01-02' THEN coalesce(r, TIMESTAMP '2024-01-02') WHEN r > TIMESTAMP '2024-01-02' THEN r END AS read_at FROM n LEFT JOIN r ON n.user_id = r.user_id)
SELECT * FROM k WHERE read_at IS NOT NULL""",
)
def m5(spark, sf):
    e = _events(spark, sf)
    notices = e.filter("user_id % 7 > 0 AND value > 25").groupBy("user_id").agg(F.min("ts").alias("appeared"))
    reads = e.filter("event_type = 'view' AND value > 28").select("user_id", F.col("ts").alias("read"))
    return L.repaired_reads(notices, reads, "user_id", "appeared", "read", "2024-01-02")


@query(
    "m6_award_markings",
    """WITH c AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'mark' WHEN 'error' THEN 'unmark' END AS op, props FROM events WHERE event_type IN ('purchase', 'error')),
d AS (SELECT user_id, max((ts, event_id)) AS d FROM c WHERE op = 'unmark' GROUP BY 1)
SELECT c.user_id, min(ts) AS marked_at, max(ts) AS updated_at, arg_max(props, (ts, event_id)) AS status FROM c LEFT JOIN d ON c.user_id = d.user_id WHERE op = 'mark' AND (d IS NULL OR (ts, event_id) > d) GROUP BY 1""",
)
def m6(spark, sf):
    op = F.when(F.col("event_type") == "purchase", "mark").otherwise("unmark")
    return L.markings(_events(spark, sf).filter("event_type IN ('purchase', 'error')").withColumn("op", op), "user_id", "op", "props", "ts", "event_id")


@query(
    "m7_check_merge",
    """WITH p AS (SELECT o_custkey AS k, count(*) AS a FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1),
c AS (SELECT o_custkey AS k, count(*) > 3 AS ok, count_if(o_orderstatus = 'F') - 2 AS a0, count_if(o_orderpriority = '1-URGENT') - 3 AS f0 FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1),
x AS (SELECT k, ok, greatest(a0, 0) AS a, f0 FROM c), o AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN f0 > 0 THEN 'conflict' WHEN a = 0 THEN 'none' ELSE 'published' END AS outcome FROM x)
SELECT o.k, outcome, (CASE WHEN outcome = 'failed' OR (outcome = 'conflict' AND o.a = 0) THEN coalesce(p.a, 0) ELSE o.a END)::BIGINT AS awards FROM o LEFT JOIN p ON o.k = p.k""",
)
def m7(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    before = o.filter(F.col("o_orderdate") < cut).groupBy("k").agg(F.count("*").alias("awards"))
    checks = o.filter(F.col("o_orderdate") >= cut).groupBy("k").agg(
        (F.count("*") > 3).alias("ok"), F.greatest(F.count_if(F.col("o_orderstatus") == "F") - 2, F.lit(0)).alias("awards"), (F.count_if(F.col("o_orderpriority") == "1-URGENT") - 3).alias("conflicts")
    )
    return L.merged_checks(before, checks, "k", "ok", "awards", "conflicts")


def _imports(spark, sf):
    c = table(spark, sf, "customer")
    nation = F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_nationkey").cast("string"))
    stored = c.filter("c_custkey % 10 < 8").select("c_custkey", F.col("c_mktsegment").alias("status"), nation.alias("nation"), F.col("c_name").alias("name"), format_money(F.abs("c_acctbal")).alias("amount"))
    new_status = F.when(F.col("c_mktsegment") == "BUILDING", "MACHINERY").otherwise("FURNITURE")
    new_name = F.when(F.col("c_custkey") % 4 == 0, "other").otherwise(F.col("c_name"))
    amount = (F.abs("c_acctbal").cast("decimal(18,2)") + (F.col("c_custkey") % 7 == 0).cast("int")).cast("string")
    incoming = c.filter("c_custkey % 10 > 1").select("c_custkey", new_status.alias("status"), F.col("c_nationkey").cast("string").alias("nation"), new_name.alias("name"), amount.alias("amount"), F.lit(1).alias("seq"))
    return L.import_merge(stored, incoming, "c_custkey", ["status", "nation", "name", "amount"], "seq", {"status": [("BUILDING", "MACHINERY")]}, {"amount": "amount"})


IMPORTED = """WITH s AS (SELECT c_custkey AS k, c_mktsegment AS status, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey::VARCHAR END AS nation, c_name AS name, abs(c_acctbal)::DECIMAL(18,2) AS amount FROM customer WHERE c_custkey % 10 < 8),
i AS (SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 'MACHINERY' ELSE 'FURNITURE' END AS status, c_nationkey::VARCHAR AS nation, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE c_name END AS name, abs(c_acctbal)::DECIMAL(18,2) + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS amount FROM customer WHERE c_custkey % 10 > 1)"""
_PESOS = "'PHP ' || format('{:,.2f}', s.amount::DOUBLE)"


@query(
    "m8_import_merge",
    f"""{IMPORTED} SELECT coalesce(s.k, i.k) AS c_custkey, CASE WHEN s.status IS NULL OR (s.status = 'BUILDING' AND i.status = 'MACHINERY') THEN i.status ELSE s.status END AS status, coalesce(s.nation, i.nation) AS nation, coalesce(s.name, i.name) AS name, coalesce({_PESOS}, i.amount::DECIMAL(18,2)::VARCHAR) AS amount FROM s FULL JOIN i ON s.k = i.k""",
)
def m8(spark, sf):
    return _imports(spark, sf)[0]


@query(
    "m8_import_log",
    f"""{IMPORTED}, l AS (SELECT coalesce(s.k, i.k) AS c_custkey, unnest([{{'field': 'status', 'a': s.status, 'b': i.status}}, {{'field': 'nation', 'a': s.nation, 'b': i.nation}}, {{'field': 'name', 'a': s.name, 'b': i.name}}, {{'field': 'amount', 'a': {_PESOS}, 'b': CASE WHEN s.amount = i.amount THEN NULL ELSE i.amount::DECIMAL(18,2)::VARCHAR END}}]) AS x FROM s FULL JOIN i ON s.k = i.k)
SELECT c_custkey, x.field AS field, x.a AS stored, x.b AS incoming, CASE WHEN x.a IS NULL THEN 'filled' WHEN x.field = 'status' AND x.a = 'BUILDING' AND x.b = 'MACHINERY' THEN 'changed' ELSE 'conflict' END AS action FROM l WHERE x.b IS NOT NULL AND x.a IS DISTINCT FROM x.b""",
)
def m8_log(spark, sf):
    return _imports(spark, sf)[1]


def _batch(spark, sf):
    """Orders as an import of texts: some without a key, a customer, or an amount or date that can be read; each key up to twice."""
    n = F.col("o_orderkey") % 7
    key = F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_orderkey") / 2).cast("string"))
    amount = F.when(n == 1, "about a million").when(n == 2, format_money(F.col("o_totalprice"))).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    day = F.when(n == 3, "31-Feb-1995").when(n == 4, "soon").when(n == 5, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    rows = table(spark, sf, "orders").select(key.alias("award"), F.when(n != 0, F.concat(F.lit(" c"), F.col("o_custkey").cast("string"))).otherwise(" ").alias("supplier"), amount.alias("amount"), day.alias("day"), F.col("o_orderkey").alias("seq"))
    return L.screened_import(rows, "award", {"amount": "amount", "day": "date"}, ["supplier"])


_BATCH = """(SELECT CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey // 2)::VARCHAR END AS award, o_orderkey AS seq, o_orderkey % 7 AS n,
CASE WHEN o_orderkey % 11 = 0 THEN 'missing award' WHEN o_orderkey % 7 = 0 THEN 'missing supplier' WHEN o_orderkey % 7 = 1 THEN 'unrecognized amount: amount' WHEN o_orderkey % 7 IN (3, 4) THEN 'unrecognized date: day' END AS error FROM orders)"""


@query("m8_import_rejected", f"SELECT award, error FROM {_BATCH} WHERE error IS NOT NULL")
def m8_rejected(spark, sf):
    """Rows of an import that can't be read, with the reason."""
    return _batch(spark, sf)[1]


@query(
    "m8_import_duplicates",
    f"""WITH b AS (SELECT * FROM {_BATCH} WHERE error IS NULL), k AS (SELECT DISTINCT c_custkey::VARCHAR AS award FROM customer)
SELECT award, seq FROM b WHERE award IN (SELECT award FROM k) OR EXISTS (SELECT 1 FROM b AS x WHERE x.award = b.award AND x.seq < b.seq)""",
)
def m8_duplicates(spark, sf):
    """Rows of an import whose key is stored or came before."""
    stored = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("award"))
    return L.import_duplicates(stored, _batch(spark, sf)[0], "award", "seq")


@query(
    "m9_history",
    """WITH b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), c AS (SELECT * FROM b WHERE before IS NULL OR before <> event_type)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS version, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM c""",
)
def m9(spark, sf):
    return L.history(_events(spark, sf), "user_id", "event_id", ["event_type"]).select("user_id", "event_id", "event_type", "version", "until")


@query(
    "m10_party_standing",
    """WITH r AS (SELECT l_orderkey, o_orderpriority AS p, CASE WHEN l_suppkey % 10 >= 6 THEN '' ELSE trim(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g')) END AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT r.*, n IN (SELECT trim(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g')) FROM supplier WHERE s_suppkey < 50) AS own FROM r),
c AS (SELECT l_orderkey, any_value(p) AS p, count_if(own) AS ours, count_if(n = '') AS blank, count(*)::BIGINT AS n_parties FROM o GROUP BY 1)
SELECT l_orderkey, CASE p[1] WHEN '1' THEN 'failed' WHEN '2' THEN 'conflict' WHEN '3' THEN 'never' ELSE
  CASE WHEN ours > 0 AND ours + blank < n_parties THEN 'mixed' WHEN ours > 0 THEN 'own' WHEN blank = 0 THEN 'other' ELSE 'unverified' END END AS standing, n_parties FROM c""",
)
def m10(spark, sf):
    s = table(spark, sf, "supplier")
    bids = table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.when(F.col("l_suppkey") % 10 >= 6, "").otherwise(party_name(F.col("s_name")))
    first = F.substring("o_orderpriority", 1, 1)
    outcome = F.when(first == "1", "failed").when(first == "2", "conflict").when(first != "3", "published")
    ours = s.filter("s_suppkey < 50").select(party_name(F.col("s_name")).alias("alias"))
    return L.party_standing(bids.select("l_orderkey", "l_suppkey", "s_name", "o_orderpriority"), "l_orderkey", name, ours, "alias", outcome)


def _reclassified(spark, sf):
    new = C.classify(titled(spark, sf), "title", CORPUS).select("doc_id", "title", C.label(F.col("relevance")).alias("after"), F.col("relevance.rule").alias("rule"))
    old = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "manual").otherwise("automatic").alias("src"), F.when(F.col("quality") == 1, "product").otherwise("not relevant").alias("before"))
    return new.join(old, "doc_id")


_RECLASS = f"""(SELECT t.doc_id, title, label AS after, rule, CASE WHEN toxic = 1 THEN 'manual' ELSE 'automatic' END AS src, CASE WHEN quality = 1 THEN 'product' ELSE 'not relevant' END AS before
FROM ({sql_classified(TITLED, "doc_id, title", "title")}) t JOIN labels l ON t.doc_id = l.doc_id)"""


@query("m11_reclassification_plan", f"SELECT doc_id, CASE WHEN src = 'manual' THEN 'skip-manual' WHEN after = 'review' THEN 'keep' WHEN before = after THEN 'refresh' ELSE 'update' END AS plan FROM {_RECLASS}")
def m11(spark, sf):
    return _reclassified(spark, sf).select("doc_id", L.reclassification_plan(F.col("src"), F.col("before"), F.col("after")).alias("plan"))


@query("a9_transitions", f"SELECT before, after, count(*)::BIGINT AS n FROM {_RECLASS} GROUP BY 1, 2")
def a9(spark, sf):
    return R.transition_matrix(_reclassified(spark, sf), "before", "after")


@query("a9_moved", f"SELECT before, after, doc_id, substr(title, 1, 160) AS title, rule AS reason FROM {_RECLASS} WHERE before <> after")
def a9_moved(spark, sf):
    """Documents whose class changes, one row each."""
    return R.moved(_reclassified(spark, sf), "before", "after", "doc_id", "title", "rule")


@query(
    "s11_write_once",
    "WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events WHERE event_id >= 400) SELECT event_id, CASE WHEN rn = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id < 400 AND o.user_id = f.user_id AND o.event_type = f.event_type) THEN 'saved' ELSE 'exists' END AS outcome FROM f",
)
def s11(spark, sf):
    e = _events(spark, sf).withColumn("key", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    return L.keep_first_append(e.filter("event_id < 400"), e.filter("event_id >= 400"), "key", "event_id").select("event_id", "outcome")


@query(
    "s12_upsert",
    """WITH c AS (SELECT o_orderkey, o_totalprice AS price, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN 'manual' END AS source FROM orders WHERE o_orderkey % 10 < 7),
n AS (SELECT o_orderkey, o_totalprice * 2 AS price, 'new' AS priority, 'automatic' AS source FROM orders WHERE o_orderkey % 10 > 3)
SELECT coalesce(c.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.price, c.price) AS price, coalesce(n.priority, c.priority) AS priority, coalesce(c.source, n.source) AS source FROM c FULL JOIN n ON c.o_orderkey = n.o_orderkey""",
)
def s12(spark, sf):
    o = table(spark, sf, "orders")
    cur = o.filter("o_orderkey % 10 < 7").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "F", "manual").alias("source"))
    new = o.filter("o_orderkey % 10 > 3").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price"), F.lit("new").alias("priority"), F.lit("automatic").alias("source"))
    return L.upsert(cur, new, "o_orderkey", ["source"])


@query(
    "e19_completeness",
    """WITH b AS (SELECT o_orderkey, o_orderpriority LIKE '1%' AS flag, list_filter([CASE WHEN o_orderstatus = 'P' THEN 'deadline' END, CASE WHEN o_totalprice < 100000 THEN 'budget' END], lambda x: x IS NOT NULL) AS missing, o_custkey % 5 = 0 AS gap FROM orders)
SELECT o_orderkey, array_to_string(missing, ',') AS missing, CASE WHEN flag THEN 'needs_review' WHEN len(missing) > 0 OR gap THEN 'partial' ELSE 'complete' END AS status FROM b""",
)
def e19(spark, sf):
    core = {"deadline": F.nullif("o_orderstatus", F.lit("P")), "budget": F.when(F.col("o_totalprice") >= 100000, F.col("o_totalprice"))}
    missing, status = L.completeness(core, {"items": F.when(F.col("o_custkey") % 5 != 0, F.lit(1))}, F.col("o_orderpriority").startswith("1"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(missing, ",").alias("missing"), status.alias("status"))
