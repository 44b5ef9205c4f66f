"""Queries of filters, joins, aggregates, windows, limits and sets over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import relational as R
from ..session import table
from .registry import query

DAY = "CAST(o_orderdate AS DATE)"


@query(
    "p1_mode_and_window",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderdate::DATE BETWEEN '1996-01-01' AND '1997-06-30' GROUP BY 1",
)
def p1(spark, sf):
    return R.in_mode_and_window(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "Urgent", "o_orderdate", "1996-01-01", "1997-06-30").select("o_custkey", "o_orderkey")


@query("p2_latest_n", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY 2 LIMIT 20")
def p2(spark, sf):
    return R.latest(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 20, F.col("o_orderstatus") == "O").select("o_custkey", "o_orderkey")


def _notices(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    label = F.when(F.col("o_orderpriority").startswith("1"), "product").when(F.col("o_orderpriority").startswith("2"), "review").otherwise("not relevant")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "in-progress")
    portal = F.when(F.col("o_orderkey") % 4 == 0, "legacy").otherwise("current")
    return o.select(F.col("o_orderkey").alias("reference"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("organization"), F.col("o_orderdate").alias("day"), label.alias("label"), status.alias("work_status"), portal.alias("portal"))


NOTICES = """(SELECT o_orderkey AS reference, c_name AS title, c_mktsegment AS organization, o_orderdate AS day,
CASE WHEN o_orderpriority LIKE '1%' THEN 'product' WHEN o_orderpriority LIKE '2%' THEN 'review' ELSE 'not relevant' END AS label,
CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in-progress' END AS work_status, CASE WHEN o_orderkey % 4 = 0 THEN 'legacy' ELSE 'current' END AS portal
FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "p3_faceted_filter",
    f"""SELECT reference FROM {NOTICES} WHERE day::DATE BETWEEN '1996-03-01' AND '2000-03-01' AND portal = 'current' AND label = 'product' AND coalesce(work_status, 'new') <> 'done'
AND contains(lower(reference || ' ' || title || ' ' || organization), 'build')""",
)
def p3(spark, sf):
    return R.faceted(_notices(spark, sf), portal="current", label="product", work_status="active", start="1996-03-01", end="2000-03-01", search=" BUILD ").select("reference")


@query("p4_published_range", f"SELECT reference, portal FROM {NOTICES} WHERE day::DATE >= '2000-01-01' AND portal = 'legacy'")
def p4(spark, sf):
    return R.faceted(_notices(spark, sf), portal="legacy", start="2000-01-01").select("reference", "portal")


@query("p5_public_columns", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'https://example.org/n/x' || c_custkey ELSE 'https://example.org/n/' || c_custkey END AS url FROM customer")
def p5(spark, sf):
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://example.org/n/x"), F.col("c_custkey").cast("string"))).otherwise("http://internal/")
    return R.public_columns(table(spark, sf, "customer").withColumn("url", url), ["c_custkey", "c_name"], "url", "c_custkey", "https://example.org/n/")


@query("p6_notice_summary", f"SELECT reference, title, organization, day, label, CASE WHEN label = 'product' THEN coalesce(work_status, 'new') END AS public_status, portal, portal = 'legacy' AS login_required FROM {NOTICES}")
def p6(spark, sf):
    return R.notice_summary(_notices(spark, sf), ["reference", "title", "organization", "day"], "label", "work_status", "portal")


@query(
    "p9_evidence_text",
    """WITH l AS (SELECT l_orderkey, string_agg('Item: ' || l_partkey || chr(10) || 'Unit: ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS items FROM lineitem GROUP BY 1)
SELECT o_orderkey, md5('Title: ' || o_orderpriority || chr(10) || 'Mode: ' || o_orderstatus || coalesce(chr(10) || items, '')) AS digest FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
)
def p9(spark, sf):
    item = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    o = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = R.evidence_text(o, {"Title": "o_orderpriority", "Mode": "o_orderstatus"}, "items", {"Item": "l_partkey", "Unit": "l_returnflag"})
    return o.select("o_orderkey", F.md5(text).alias("digest"))


@query("p10_reuse_eligible", "SELECT d.doc_id, coalesce(l.quality = 1 AND l.toxic IS NOT NULL, false) AS reusable FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "product")
    return d.select("doc_id", R.reusable(F.col("quality").isNotNull(), F.col("toxic").isNotNull(), label).alias("reusable"))


@query(
    "p11_case_report",
    """SELECT o_orderkey, c_name AS organization, CASE WHEN c_name IS NOT NULL THEN 'not recorded' END AS organization_confidence, 'PHP ' || format('{:,.2f}', o_totalprice::DECIMAL(18,2)::DOUBLE) AS budget,
CASE WHEN o_orderpriority LIKE '1%' THEN 'annex.pdf' WHEN o_orderpriority LIKE '2%' THEN NULL ELSE 'notice' END AS budget_source, CASE WHEN o_orderpriority LIKE '1%' THEN 'medium' WHEN o_orderpriority LIKE '2%' THEN 'low' ELSE 'high' END AS budget_confidence, coalesce(n, 0)::BIGINT AS n_items, coalesce(qty, 0)::DOUBLE AS quantity,
CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS reviewed FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def p11(spark, sf):
    from ..functions.money import format_money

    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    first = F.substring("o_orderpriority", 1, 1)
    budget = F.struct(
        format_money(F.col("o_totalprice")).alias("value"), F.when(first == "1", "annex.pdf").when(first != "2", "notice").alias("source"),
        F.when(first == "1", "medium").when(first == "2", "low").otherwise("high").alias("confidence"),
    )
    fields = {"organization": F.col("c_name"), "budget": budget}
    reviewed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    got = R.case_report(o, table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", "l_quantity", fields, reviewed)
    return got.select("o_orderkey", F.col("organization.value").alias("organization"), F.col("organization.confidence").alias("organization_confidence"), F.col("budget.value").alias("budget"), F.col("budget.source").alias("budget_source"), F.col("budget.confidence").alias("budget_confidence"), "n_items", "quantity", "reviewed")


@query("p12_packet_projection", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), '') AS title, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, [o_orderpriority] AS tags FROM orders")
def p12(spark, sf):
    texts = {"title": F.nullif("o_orderpriority", F.lit("5-LOW"))}
    return R.with_defaults(table(spark, sf, "orders"), "o_orderkey", texts, {"status": F.nullif("o_orderstatus", F.lit("P"))}, {"tags": F.array("o_orderpriority")})


@query(
    "p13_validation",
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'amount' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END, CASE WHEN c_nationkey > 20 THEN 'nation' END], lambda x: x IS NOT NULL), ',') AS errors
FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY' OR c_nationkey > 20""",
)
def p13(spark, sf):
    return R.validated(table(spark, sf, "customer"), "c_custkey", _customer_rules())[1].select("c_custkey", F.array_join("errors", ",").alias("errors"))


def _customer_rules():
    return {"amount": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "MACHINERY", "nation": F.col("c_nationkey") <= 20}


@query("p13_valid", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' AND c_nationkey <= 20")
def p13_valid(spark, sf):
    """The records that pass the same rules."""
    return R.validated(table(spark, sf, "customer"), "c_custkey", _customer_rules())[0].select("c_custkey", "c_name")


@query(
    "j1_notice_requirements",
    "SELECT o_orderkey, n_items, total, n_items IS NOT NULL AS found FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey",
)
def j1(spark, sf):
    req = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_items"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    empty = table(spark, sf, "orders").select("o_orderkey", F.lit(None).cast("bigint").alias("n_items"), F.lit(None).cast("double").alias("total"))
    return R.overlay(empty, req, "o_orderkey", {"n_items": "n_items", "total": "total"})


@query("j2_unread", "SELECT d.doc_id, l.doc_id IS NULL AS unread FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j2(spark, sf):
    return R.unread(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(
    "j3_scan_rows_state",
    """SELECT o_orderstatus, CASE WHEN c_acctbal < 0 THEN 'reuse' WHEN o_orderpriority = '5-LOW' THEN 'skip' WHEN c_nationkey < 5 THEN 'reuse' ELSE 'process' END AS plan, count(*)::BIGINT AS n
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING' GROUP BY ALL""",
)
def j3(spark, sf):
    """Plans of scan rows; customers of one segment have no saved state."""
    state = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select("c_custkey", (F.col("c_acctbal") < 0).alias("is_manual"), (F.col("c_nationkey") < 5).alias("reusable"))
    rows = R.planned_rows(table(spark, sf, "orders"), state, "o_custkey", "c_custkey", F.col("o_orderpriority") == "5-LOW")
    return rows.groupBy("o_orderstatus", "plan").agg(F.count("*").alias("n"))


@query("j4_snapshot_overlay", "SELECT event_id, coalesce(c_mktsegment, event_type) AS label, c_custkey IS NOT NULL AS found FROM events LEFT JOIN customer ON user_id = c_custkey AND c_nationkey < 12")
def j4(spark, sf):
    current = table(spark, sf, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    snap = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("label"))
    return R.overlay(snap, current, "user_id", {"label": "c_mktsegment"}).select("event_id", "label", "found")


WEEKLY = "(SELECT date_trunc('week', ts + INTERVAL 8 HOUR)::DATE AS week, user_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS kind, ts, event_id, event_type, value FROM events)"


def _kind():
    return F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)


@query(
    "j5_weekly_groups_with_state",
    f"""WITH g AS (SELECT week, user_id, min(kind) AS kind FROM {WEEKLY} GROUP BY 1, 2)
SELECT week, user_id, c_name AS title, CASE WHEN kind = 0 THEN coalesce(c_mktsegment, 'not recorded') END AS status FROM g LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0""",
)
def j5(spark, sf):
    g = R.weekly_groups(table(spark, sf, "events"), "ts", "user_id", _kind(), "event_id", "event_type")
    c = table(spark, sf, "customer").filter("c_acctbal > 0")
    return R.weekly_state(g, c, "user_id", "c_custkey", {"title": "c_name"}, "c_mktsegment").drop("kind")


@query("j6_marking_live_over_stored", "SELECT o_orderkey, coalesce(c_name, 'stored ' || o_custkey) AS title, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'MACHINERY'")
def j6(spark, sf):
    marks = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("stored "), F.col("o_custkey").cast("string")).alias("title"))
    return R.overlay(marks, table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'"), "c_custkey", {"title": "c_name"}).select("o_orderkey", "title", "found")


@query("j7_award_overview", "SELECT c_custkey, coalesce(outcome, 'never') AS outcome FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS outcome FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey")
def j7(spark, sf):
    rec = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("outcome"))
    return R.overview(table(spark, sf, "customer").select("c_custkey"), rec, "c_custkey")


@query(
    "j8_exact_awards",
    """WITH o AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem SEMI JOIN o ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS k FROM a)
SELECT l_orderkey, l_partkey, k > 3 AS truncated FROM n WHERE rn <= 3""",
)
def j8(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.exact_awards(table(spark, sf, "lineitem"), wanted, "l_orderkey", "l_partkey", 3).select("l_orderkey", "l_partkey", "truncated")


def _details(spark, sf):
    details = table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("bigint").alias("l_suppkey"), F.col("p_retailprice").alias("price"))
    return R.checked_details(table(spark, sf, "lineitem").withColumn("price", F.lit(None).cast("double")), details, "l_suppkey", "l_partkey", ["price"])


@query("j8_detail_conflicts", "SELECT l_partkey, l_suppkey, p_size::BIGINT AS detail_reference FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <> l_suppkey AND p_size < 10")
def j8_detail(spark, sf):
    return _details(spark, sf)[1]


@query("j8_detail_values", "SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 10) ON l_partkey = p_partkey WHERE p_size IS NULL OR p_size = l_suppkey")
def j8_values(spark, sf):
    """List rows without a conflict, with the values of their details."""
    return _details(spark, sf)[0].select("l_orderkey", "l_linenumber", "l_partkey", "price")


@query("j9_uniqueness_guard", "SELECT a.o_orderkey, a.o_custkey FROM orders a SEMI JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P') b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderstatus = 'F'")
def j9(spark, sf):
    o = table(spark, sf, "orders")
    return R.taken_elsewhere(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query("a1_label_counts", 'SELECT count(*)::BIGINT AS "all", count_if(event_type = \'click\')::BIGINT AS click, count_if(event_type = \'view\')::BIGINT AS view FROM events')
def a1(spark, sf):
    return R.count_by_label(table(spark, sf, "events"), "event_type", ["click", "view"])


@query(
    "a2_scan_outcomes",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id % 10, floor(value * 100)::BIGINT ORDER BY event_id) AS rn FROM events WHERE floor(value * 100) IS NOT NULL), o AS (SELECT * FROM f WHERE rn = 1)
SELECT user_id % 10 AS scan, count(*)::BIGINT AS discovered, count_if(event_type = 'error')::BIGINT AS errors, count_if(event_type = 'signup')::BIGINT AS already, count_if(event_type NOT IN ('error', 'signup') AND value > 20)::BIGINT AS product,
count_if(event_type NOT IN ('error', 'signup') AND NOT value > 20)::BIGINT AS other, coalesce(sum(CASE WHEN event_type <> 'signup' THEN user_id END), 0)::BIGINT AS downloads FROM o GROUP BY 1""",
)
def a2(spark, sf):
    e = table(spark, sf, "events").withColumns({"scan": F.col("user_id") % 10, "key": F.floor(F.col("value") * 100).cast("long")})
    buckets = {"errors": F.col("event_type") == "error", "already": F.col("event_type") == "signup", "product": F.col("value") > 20}
    return R.outcome_counts(e, "scan", "key", "event_id", buckets, "user_id", F.col("event_type") == "signup")


@query(
    "a3_reclassify_counts",
    """SELECT user_id % 7 AS run, count(*)::BIGINT AS examined, count_if(event_type = 'error')::BIGINT AS errors, count_if(event_type = 'signup')::BIGINT AS manual, count_if(event_type NOT IN ('error', 'signup'))::BIGINT AS reclassified,
count_if(event_type = 'purchase')::BIGINT AS product, count_if(event_type = 'click')::BIGINT AS review, count_if(event_type NOT IN ('error', 'signup', 'purchase', 'click'))::BIGINT AS not_relevant,
count_if(event_type = 'view')::BIGINT AS inspected, count_if(value > 100)::BIGINT AS downloaded FROM events GROUP BY 1""",
)
def a3(spark, sf):
    t = F.col("event_type")
    label = F.when(t == "purchase", "product").when(t == "click", "review").otherwise("not relevant")
    e = table(spark, sf, "events").withColumn("run", F.col("user_id") % 7)
    return R.reclassify_counts(e, "run", t == "error", t == "signup", label, t == "view", F.col("value") > 100)


_SCANS = "(SELECT user_id % 200 AS scan, *, CASE WHEN user_id % 9 <> 0 THEN floor(value * 10)::BIGINT END AS ident FROM events)"
_LISTED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan, ident ORDER BY event_id) AS rn FROM {_SCANS} WHERE event_type = 'purchase' AND value <= 60) WHERE ident IS NULL OR rn = 1)"""
_MESSAGES = f"""(SELECT scan, event_id, 'row ' || event_id AS message FROM {_SCANS} WHERE event_type = 'error' OR value > 60
UNION ALL SELECT scan, NULL, 'ended early' FROM {_SCANS} GROUP BY scan HAVING scan % 3 = 0 AND count_if(event_type = 'error' OR value > 60) = 0)"""


def _scans(spark, sf):
    ident = F.when(F.col("user_id") % 9 != 0, F.floor(F.col("value") * 10).cast("long"))
    error = F.when((F.col("event_type") == "error") | (F.col("value") > 60), F.concat(F.lit("row "), F.col("event_id").cast("string")))
    return table(spark, sf, "events").withColumn("scan", F.col("user_id") % 200), ident, error, F.when(F.col("scan") % 3 == 0, "ended early")


@query(
    "a4_scan_reports",
    f"""WITH l AS (SELECT scan, count(*) AS listed, count_if(value > 30) AS saved FROM {_LISTED} GROUP BY 1), m AS (SELECT scan, count(*) AS errors FROM {_MESSAGES} GROUP BY 1)
SELECT e.scan, count(*)::BIGINT AS discovered, count_if(event_type = 'purchase')::BIGINT AS products, coalesce(any_value(m.errors), 0)::BIGINT AS errors,
coalesce(any_value(listed), 0)::BIGINT AS listed, coalesce(any_value(saved), 0)::BIGINT AS previously_saved FROM {_SCANS} e LEFT JOIN l ON e.scan = l.scan LEFT JOIN m ON e.scan = m.scan GROUP BY 1""",
)
def a4(spark, sf):
    e, ident, error, stopped = _scans(spark, sf)
    return R.scan_report(e, "scan", ident, "event_id", F.col("event_type") == "purchase", F.col("value") > 30, error, "props", stopped)


@query("a4_scan_listed", f"SELECT scan, event_id, ident AS identity, props AS title, value > 30 AS previously_saved FROM {_LISTED}")
def a4_listed(spark, sf):
    """The products that the reports of scans list."""
    e, ident, error, _ = _scans(spark, sf)
    return R.scan_listed(e, "scan", ident, "event_id", F.col("event_type") == "purchase", F.col("value") > 30, "props", error)


@query("a4_scan_errors", f"SELECT * FROM {_MESSAGES}")
def a4_errors(spark, sf):
    """The messages that the reports of scans list."""
    e, _, error, stopped = _scans(spark, sf)
    return R.scan_errors(e, "scan", "event_id", error, stopped)


@query("a5_sum_with_coverage", "SELECT event_type, round(sum(CASE WHEN user_id % 3 > 0 THEN value END), 2) AS total, count_if(user_id % 3 > 0)::BIGINT AS recorded, count_if(user_id % 3 = 0)::BIGINT AS missing FROM events GROUP BY 1")
def a5(spark, sf):
    e = table(spark, sf, "events").withColumn("x", F.when(F.col("user_id") % 3 > 0, F.col("value").cast("string")).otherwise("n/a"))
    return R.coverage_sum(e, "x", "event_type").withColumn("total", F.round("total", 2))


@query(
    "a6_weekly_report",
    f"""WITH g AS (SELECT week, CASE WHEN user_id % 11 > 0 THEN user_id END AS ident, min(kind) AS kind FROM {WEEKLY} GROUP BY 1, 2),
k AS (SELECT week, count_if(kind = 0) AS new, count_if(kind = 1) AS saved, count_if(kind = 2) AS unknown FROM g WHERE ident IS NOT NULL GROUP BY 1)
SELECT w.week, count_if(event_type = 'click')::BIGINT AS complete, count_if(event_type = 'error')::BIGINT AS incomplete, count_if(event_type NOT IN ('click', 'error'))::BIGINT AS not_recorded, count_if(user_id % 11 = 0)::BIGINT AS without_identity,
CASE WHEN bool_and(value < 0) THEN 'legacy' ELSE 'mixed or current' END AS source, any_value(k.new)::BIGINT AS new, any_value(k.saved)::BIGINT AS saved, any_value(k.unknown)::BIGINT AS unknown FROM {WEEKLY} w LEFT JOIN k ON w.week = k.week GROUP BY 1""",
)
def a6(spark, sf):
    e = table(spark, sf, "events").withColumn("ident", F.when(F.col("user_id") % 11 > 0, F.col("user_id")))
    complete = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "error", False)
    return R.weekly_report(e, "ts", "ident", _kind(), "event_id", "event_type", complete, F.col("value") < 0)


@query(
    "a6_weekly_status",
    f"""WITH g AS (SELECT week, user_id, min(kind) AS kind FROM {WEEKLY} GROUP BY 1, 2),
s AS (SELECT week, CASE WHEN c_custkey IS NULL THEN 'none' ELSE CASE c_nationkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'in-progress' WHEN 2 THEN 'done' ELSE 'none' END END AS status FROM g LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0 WHERE kind = 0)
SELECT week, count_if(status = 'new')::BIGINT AS new_status, count_if(status = 'in-progress')::BIGINT AS in_progress, count_if(status = 'done')::BIGINT AS done, count_if(status = 'none')::BIGINT AS not_recorded FROM s GROUP BY 1""",
)
def a6_status(spark, sf):
    """The new groups of a week by the work status of their packets."""
    g = R.weekly_groups(table(spark, sf, "events"), "ts", "user_id", _kind(), "event_id", "event_type")
    n = F.col("c_nationkey") % 4
    packets = table(spark, sf, "customer").filter("c_acctbal > 0").withColumn("status", F.when(n == 0, "new").when(n == 1, "in-progress").when(n == 2, "done").otherwise("later"))
    return R.weekly_status(g, packets, "user_id", "c_custkey", "status")


@query(
    "a6_weekly_errors",
    f"""WITH m AS {_MESSAGES}, s AS (SELECT scan, min(ts) AS started_at FROM {_SCANS} GROUP BY 1)
SELECT date_trunc('week', started_at + INTERVAL 8 HOUR)::DATE AS week, m.scan, started_at, CASE WHEN user_id % 9 <> 0 THEN (user_id)::VARCHAR END AS reference, message FROM m JOIN s ON m.scan = s.scan LEFT JOIN events e ON m.event_id = e.event_id""",
)
def a6_errors(spark, sf):
    """The messages of the scans of a week."""
    e, _, error, stopped = _scans(spark, sf)
    reference = F.when(F.col("user_id") % 9 != 0, F.col("user_id"))
    return R.weekly_errors(e, "scan", "ts", "event_id", reference, error, stopped)


@query("a7_award_summary", "SELECT count(*)::BIGINT AS n, count_if(o_orderpriority = '1-URGENT')::BIGINT AS pending, count_if(o_orderpriority <> '1-URGENT')::BIGINT AS accepted, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) END)::DECIMAL(28,2) AS total FROM orders")
def a7(spark, sf):
    return R.award_summary(table(spark, sf, "orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", "o_totalprice")


@query("a8_outcome_totals", "SELECT count(*)::BIGINT AS n, count_if(o_orderstatus = 'F')::BIGINT AS published, count_if(o_orderstatus = 'O')::BIGINT AS never, (count(*) - count_if(o_orderstatus = 'O'))::BIGINT AS checked, max(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END) AS last_check FROM orders")
def a8(spark, sf):
    return R.outcome_totals(table(spark, sf, "orders"), "o_orderstatus", "o_orderdate", {"published": "F"}, "O")


@query(
    "a10_run_statistics",
    """WITH k AS (SELECT *, user_id % 10 AS run, row_number() OVER (PARTITION BY user_id % 10, floor(value * 10)::BIGINT ORDER BY event_id) AS rn FROM events)
SELECT run, count(*)::BIGINT AS listed, count_if(rn > 1)::BIGINT AS duplicates_skipped, count_if(rn = 1)::BIGINT AS inspected, count_if(rn = 1 AND value < 50)::BIGINT AS small_value, count_if(rn = 1 AND event_type <> 'error')::BIGINT AS classified,
count_if(rn = 1 AND event_type = 'purchase')::BIGINT AS saved, count_if(rn = 1 AND event_type = 'signup')::BIGINT AS already_saved, count_if(rn = 1 AND event_type = 'click')::BIGINT AS product, count_if(rn = 1 AND event_type = 'view')::BIGINT AS not_relevant,
count_if(rn = 1 AND event_type NOT IN ('click', 'view', 'error'))::BIGINT AS review, count_if(rn = 1 AND event_type = 'error')::BIGINT AS errors, count(DISTINCT event_id // 250)::BIGINT AS pages_visited,
arg_min('at ' || event_id, event_id) FILTER (WHERE event_type = 'error' AND value > 100) AS stop_reason, bool_or(event_type = 'error' AND value > 100) AS stopped FROM k GROUP BY 1""",
)
def a10(spark, sf):
    e = table(spark, sf, "events").withColumns({"run": F.col("user_id") % 10, "key": F.floor(F.col("value") * 10).cast("long")})
    t = F.col("event_type")
    counters = {
        "inspected": F.lit(True), "small_value": F.col("value") < 50, "classified": t != "error", "saved": t == "purchase", "already_saved": t == "signup",
        "product": t == "click", "not_relevant": t == "view", "review": ~t.isin("click", "view", "error"), "errors": t == "error",
    }
    stop = F.when((t == "error") & (F.col("value") > 100), F.concat(F.lit("at "), F.col("event_id").cast("string")))
    return R.run_statistics(e, "run", "key", "event_id", F.floor(F.col("event_id") / 250), counters, stop)


@query("w1_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def w1(spark, sf):
    return R.first_per_key(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


_PAGES = "(SELECT user_id % 30 AS scan, event_id // 250 AS page, ((event_id // 500) * 7 + user_id % 5) % 11 AS ident, ts FROM events)"


def _scan_rows(spark, sf):
    e = table(spark, sf, "events")
    page, half = F.floor(F.col("event_id") / 250).cast("long"), F.floor(F.col("event_id") / 500).cast("long")
    return e.select((F.col("user_id") % 30).alias("scan"), page.alias("page"), ((half * 7 + F.col("user_id") % 5) % 11).alias("ident"), "ts")


@query(
    "w2_repeated_pages",
    f"""WITH p AS (SELECT scan, page, string_agg(DISTINCT ident::VARCHAR, ',' ORDER BY ident::VARCHAR) AS fp FROM {_PAGES} GROUP BY 1, 2)
SELECT scan, page, fp AS fingerprint, coalesce(fp = lag(fp) OVER (PARTITION BY scan ORDER BY page), false) AS repeated FROM p""",
)
def w2(spark, sf):
    return R.repeated_pages(_scan_rows(spark, sf).select("scan", "page", "ident").distinct(), "scan", "page", "ident")


@query("w3_best_with_tie", "WITH r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem) SELECT l_orderkey, max(l_quantity) AS l_quantity, count(*) > 1 AND max(l_quantity) < 40 AS tied FROM r WHERE r = 1 GROUP BY 1")
def w3(spark, sf):
    return R.best_with_tie(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber", 40).select("l_orderkey", "l_quantity", "tied")


@query("w4_precedence_first", f"SELECT week, user_id, coalesce(arg_min(event_type, (ts, event_id)) FILTER (WHERE kind = 0), arg_min(event_type, (ts, event_id))) AS title, min(kind)::INT AS kind, count(*)::BIGINT AS seen FROM {WEEKLY} GROUP BY 1, 2")
def w4(spark, sf):
    return R.weekly_groups(table(spark, sf, "events"), "ts", "user_id", _kind(), "event_id", "event_type").select("week", "user_id", "title", "kind", "seen")


@query(
    "s16_listing_coverage",
    f"""WITH x AS (SELECT DISTINCT scan, page, ident, date_trunc('day', ts) AS d FROM {_PAGES} WHERE (scan + page) % 13 <> 12), p AS (SELECT DISTINCT scan, page FROM {_PAGES}),
f AS (SELECT scan, page, string_agg(ident::VARCHAR, ',' ORDER BY ident::VARCHAR) AS fp, count(*) AS n, max(d)::DATE AS last_day FROM x GROUP BY 1, 2),
l AS (SELECT *, lag(fp) OVER (PARTITION BY scan ORDER BY page) AS before FROM f),
w AS (SELECT p.scan, p.page, n, row_number() OVER (PARTITION BY p.scan ORDER BY p.page) AS place,
  CASE WHEN n IS NULL THEN 'empty-page' WHEN fp = before THEN 'repeated-page' WHEN last_day < '2024-01-01' THEN 'date-boundary' END AS reason FROM p LEFT JOIN l ON p.scan = l.scan AND p.page = l.page),
s AS (SELECT *, CASE WHEN reason IS NULL AND place >= 12 THEN 'safety-limit' ELSE reason END AS r FROM w),
t AS (SELECT scan, min(place) FILTER (WHERE r IS NOT NULL) AS stop, arg_min(r, place) FILTER (WHERE r IS NOT NULL) AS why FROM s GROUP BY 1)
SELECT s.scan, count(*)::BIGINT AS pages_read, coalesce(sum(CASE WHEN r IN ('empty-page', 'repeated-page') THEN 0 ELSE n END), 0)::BIGINT AS rows_kept, coalesce(any_value(why), 'no-more-pages') AS reason, coalesce(any_value(why) IN ('empty-page', 'date-boundary'), false) AS complete
FROM s JOIN t ON s.scan = t.scan WHERE stop IS NULL OR place <= stop GROUP BY 1""",
)
def s16(spark, sf):
    rows = _scan_rows(spark, sf)
    kept = rows.filter((F.col("scan") + F.col("page")) % 13 != 12).select("scan", "page", "ident", F.col("ts").cast("date").alias("d")).distinct()
    return R.listing_coverage(kept, rows.select("scan", "page").distinct(), "scan", "page", "ident", "d", "2024-01-01", 12)


@query("l1_newest_first", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS day FROM orders ORDER BY day DESC NULLS LAST, o_orderkey")
def l1(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return R.newest_first(o.select("o_orderkey", "day"), "day", "o_orderkey")


@query("l2_featured", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def l2(spark, sf):
    return R.featured(table(spark, sf, "orders"), (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("l3_paging", "SELECT o_orderkey, (SELECT ceil(count(*) / 50.0)::INT FROM orders) AS pages FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def l3(spark, sf):
    return R.page_of(table(spark, sf, "orders"), 3, 50, F.col("o_orderdate").desc(), F.col("o_orderkey")).select("o_orderkey", "pages")


@query(
    "l4_recheck_batch",
    "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderdate < '1997-01-01' THEN 0 ELSE 1 END, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END ASC NULLS FIRST, o_orderkey LIMIT 15",
)
def l4(spark, sf):
    o = table(spark, sf, "orders").withColumn("last", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return R.recheck_batch(o, F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "last", "o_orderkey", 15).select("o_orderkey")


@query("l5_list_orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC")
def l5(spark, sf):
    return R.latest_first(table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("u1_portal_union", "SELECT 'current' AS portal, c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'legacy', s_suppkey, s_name, NULL FROM supplier")
def u1(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.portal_union(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))).select("portal", "k", "name", "segment")


@query("u2_baseline_difference", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def u2(spark, sf):
    return R.baseline_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("u3_ordered_names", "SELECT doc_id, array_to_string(CASE WHEN source = lang THEN [source] ELSE [source, lang] END || CASE WHEN n_chars > 1000 THEN ['long'] ELSE [] END, ',') AS names FROM documents")
def u3(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array("source", "lang").alias("a"), F.array("lang", F.when(F.col("n_chars") > 1000, "long")).alias("b"))
    return R.ordered_names(d, "doc_id", "a", "b").select("doc_id", F.array_join("names", ",").alias("names"))


@query(
    "d_local_days",
    "SELECT (ts + INTERVAL 8 HOUR)::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY 1",
)
def local_days(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), D.ZONE)).alias("day")).agg(F.count("*").alias("n"))
