"""Queries of page parsing, stored files and streams, over the given tables or pages made from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import rules as R
from ..functions import text as T
from ..operators import classify as C
from ..operators import lifecycle as L
from ..sources import files as S
from ..sources import html as H
from ..sources.store import KeyedStore
from ..streaming import jobs as J
from ..session import shared_path, table
from .registry import query


def _s(c: str):
    return F.col(c).cast("string")


def _listing_pages(spark, sf, tail: str = ""):
    """A listing page for each customer that has orders."""
    row = F.concat(F.lit('<tr><td><a href="/detail?refID='), _s("o_orderkey"), F.lit('">'), _s("o_orderkey"), F.lit("</a></td><td> "), F.col("o_orderpriority"), F.lit(" </td><td>"), F.col("o_orderstatus"), F.lit("</td></tr>"))
    pages = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    return pages.select("page_id", F.concat(F.lit("<table><tr><th>Reference</th><th>Mode</th><th>Status</th></tr><tr><td>no link</td></tr>"), "rows", F.lit(f"</table>{tail}")).alias("html"))


@query("s1_packet_keys", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'legacy-' || o_orderkey ELSE o_orderkey::VARCHAR END AS storage_id FROM orders WHERE o_orderkey % 3 <> 1")
def s1(spark, sf):
    k = _s("o_orderkey")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("legacy-"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("report-"), k)).otherwise(k)
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(name, F.lit(".json")).alias("file"))
    return S.stored_rows(rows, F.col("file")).select("o_orderkey", "storage_id")


@query("s2_listing_rows", "SELECT o_custkey AS page, o_orderkey::VARCHAR AS reference, '/detail?refID=' || o_orderkey AS url, o_orderpriority AS mode, o_orderstatus AS status FROM orders")
def s2(spark, sf):
    got = H.listing_rows(H.table_rows(_listing_pages(spark, sf)), r"/detail\?refID=([0-9]+)", ["reference_text", "mode", "status"])
    return got.select("page", "reference", "url", "mode", "status")


@query("s2_page_links", """SELECT page_id AS page, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def s2_links(spark, sf):
    return H.page_links(H.cells(table(spark, sf, "pages")), "^/").groupBy("page").agg(F.count("*").alias("n"))


@query("s3_notice_details", "SELECT o_orderkey AS page, 'Order ' || o_orderkey AS title, o_orderpriority AS mode, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders")
def s3(spark, sf):
    html = F.concat(
        F.lit("<h1>Notice</h1><div>Notice Title: Order "), _s("o_orderkey"), F.lit("</div><div><b>Mode:</b> "), F.col("o_orderpriority"), F.lit("</div><span>Other: x</span>"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("<p>Status : "), F.col("o_orderstatus"), F.lit("</p>"))).otherwise(""),
    )
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), html.alias("html"))
    return H.notices(H.whole_pages(pages), {"title": ["Title", "Notice Title"], "mode": ["Mode"], "status": ["Status"]})


@query("s4_item_tables", "SELECT l_orderkey AS page, 'Part ' || l_partkey AS name, l_suppkey::VARCHAR AS unspsc, l_quantity::INT::VARCHAR AS quantity FROM lineitem")
def s4(spark, sf):
    row = F.concat(F.lit("<tr><td>"), _s("l_suppkey"), F.lit("<td>Part "), _s("l_partkey"), F.lit("</td><td>"), F.col("l_quantity").cast("int").cast("string"), F.lit("</td></tr>"))
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    pages = pages.select("page_id", F.concat(F.lit("<table><tr><th>UNSPSC</th><th>Item Description</th><th>Qty</th></tr>"), "rows", F.lit("<tr><td></td><td> </td><td></td></tr></table><table><tr><td>a</td></tr><tr><td>b</td></tr></table>")).alias("html"))
    return H.table_items(H.table_rows(pages), {"unspsc": "(?i)unspsc", "name": "(?i)description", "quantity": "(?i)qty"}, "name", "(?i)unspsc|lot|item").select("page", "name", "unspsc", "quantity")


@query(
    "s5_open_lists",
    "SELECT o_custkey AS page, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids, min(o_orderkey)::VARCHAR AS duplicates, o_custkey % 2 = 0 AS has_next, false AS failed FROM orders GROUP BY o_custkey",
)
def s5(spark, sf):
    pages = _listing_pages(spark, sf)
    again = F.regexp_extract("html", r"(<a href=\"/detail\?refID=[0-9]+\">)", 1)
    html = F.concat("html", again, F.lit("again</a>"), F.when(F.col("page_id") % 2 == 0, '<a href="/list?page=2">Next</a>').otherwise(""))
    got = H.open_list(H.whole_pages(pages.withColumn("html", html)), r"/detail\?refID=([0-9]+)", r"/list\?page=", "(?i)transaction error")
    return got.select("page", F.array_join("ids", ",").alias("ids"), F.array_join("duplicates", ",").alias("duplicates"), "has_next", "failed")


@query("s6_abstracts", "SELECT c_custkey AS page, c_name AS title, c_mktsegment AS category, CASE WHEN c_nationkey > 3 THEN c_nationkey::VARCHAR END AS area FROM customer")
def s6(spark, sf):
    area = F.when(F.col("c_nationkey") > 3, F.concat(F.lit("<tr><td>Area of Delivery :</td><td>"), _s("c_nationkey"), F.lit("</td></tr>"))).otherwise("")
    html = F.concat(F.lit("<table><tr><td>Title:</td><td>"), "c_name", F.lit("</td></tr><tr><td>Title</td><td>second</td></tr>"), area, F.lit("<tr><td>Category/</td><td> "), "c_mktsegment", F.lit("</td></tr></table>"))
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    return H.notices(H.whole_pages(pages), {"title": ["title"], "category": ["category"], "area": ["area"]}, prefix=True)


@query(
    "s7_attachment_links",
    """WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS base, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages)
SELECT page_id AS page, base || '/' || regexp_replace(href, '^/+', '') AS url, count(*)::BIGINT AS repeats FROM l GROUP BY 1, 2""",
)
def s7(spark, sf):
    pages = table(spark, sf, "pages")
    links = H.page_links(H.cells(pages), "^/").join(pages.select(F.col("page_id").alias("page"), F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("base")), "page")
    url = F.concat("base", F.lit("/"), F.regexp_replace("href", "^/+", ""))
    return links.groupBy("page", url.alias("url")).agg(F.max("n").cast("bigint").alias("repeats"))


@query("s7_attachment_names")
def s7_names(spark, sf):
    """File names, link texts and absolute urls of links; names are decoded from the url where a link has no text."""
    return H.attachment_links(H.cells(table(spark, sf, "pages")), "^/", F.lit("https://example.org")).select("page", "pos", "filename", "url_name", "url")


@query("s8_award_lists", "SELECT o_custkey AS page, o_orderkey::VARCHAR AS award, o_orderpriority AS title FROM orders WHERE o_custkey % 5 > 1")
def s8(spark, sf):
    return H.award_rows(H.table_rows(_award_pages(spark, sf)), ["award", "title", "supplier"], "Reference").select("page", "award", "title").filter("award != 'no link'")


@query("s8_malformed_pages", "SELECT DISTINCT o_custkey AS page, 'no award header' AS reason FROM orders WHERE o_custkey % 5 = 0")
def s8_bad(spark, sf):
    return H.award_list(H.cells(_award_pages(spark, sf)), ["award", "title", "supplier"], "Reference", "No Records Found")[1]


def _award_pages(spark, sf):
    k = F.col("page_id") % 5
    html = F.when(k == 0, "<p>Service Unavailable</p>").when(k == 1, "<p>No Records Found</p>").otherwise(F.col("html"))
    return _listing_pages(spark, sf).withColumn("html", html)


@query(
    "s9_text_sections",
    """WITH c AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS chunk FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\\n(The|Of|De|Der|En) )', chr(1) || '\\1', 'g'), chr(1)) AS x FROM documents)),
n AS (SELECT *, regexp_extract(chunk, '\\n(The|Of|De|Der|En) ', 1) AS name, max(regexp_extract(chunk, '\\n(The|Of|De|Der|En) ', 1) <> '') OVER (PARTITION BY doc_id) AS found FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS position, CASE WHEN found THEN name ELSE doc_id::VARCHAR END AS filename, md5(CASE WHEN found THEN regexp_replace(chunk, '^\\n(The|Of|De|Der|En) ', '') ELSE chunk END) AS digest
FROM n WHERE NOT found OR name <> ''""",
)
def s9(spark, sf):
    got = S.text_sections(table(spark, sf, "documents"), "doc_id", "text", r"\n(The|Of|De|Der|En) ")
    return got.select("doc_id", "position", "filename", F.md5("text").alias("digest"))


@query("s10_text_with_fallback", "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'stored ' || d.doc_id ELSE source END AS text, coalesce(quality, 0) <> 1 AS used_ocr FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 OR lang <> 'de'")
def s10(spark, sf):
    extracted = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("stored "), _s("doc_id"))).otherwise(" ").alias("text"))
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "de", F.col("source")).alias("raw"))
    return S.text_with_fallback(docs, extracted, "doc_id", "text", "raw")[0]


@query("s13_snapshot_listing", "SELECT user_id::VARCHAR AS scan_id, date_trunc('millisecond', max(ts)) AS started_at, count(*)::BIGINT AS discovered FROM events WHERE user_id % 9 > 0 GROUP BY user_id ORDER BY started_at DESC, scan_id DESC")
def s13(spark, sf):
    """Report texts with some that can't be read, parsed permissively."""
    r = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("started_at"), F.count("*").alias("discovered"))
    text = F.to_json(F.struct(_s("user_id").alias("scan_id"), "started_at", "discovered"))
    broken = r.select(F.when(F.col("user_id") % 9 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("report"))
    parsed = broken.select(F.from_json("report", "scan_id string, started_at timestamp_ntz, discovered bigint, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return S.newest_readable(parsed.select("r.*"))


@query(
    "s14_manifests",
    """WITH f AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber > 1) AS n, coalesce(string_agg(DISTINCT l_partkey || '.pdf', ',' ORDER BY l_partkey || '.pdf') FILTER (WHERE l_linenumber > 1), '') AS files FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, k) AS k, coalesce(files, '') AS files, coalesce(n, 0)::INT AS count, o_orderpriority AS classification FROM f FULL JOIN orders ON k = o_orderkey""",
)
def s14(spark, sf):
    path = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("documents/"), _s("l_partkey"), F.lit(".pdf"))).otherwise("documents/metadata.json")
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), path.alias("path"))
    stored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("classification"))
    return S.manifests(files, "k", "path", stored, ["classification"]).withColumn("files", F.array_join("files", ","))


@query("s15_review_list", "SELECT o_orderkey::VARCHAR AS reference, o_orderpriority AS title FROM orders WHERE o_orderkey % 4 > 0 ORDER BY o_orderkey DESC")
def s15(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(_s("o_orderkey")).alias("reference"), F.col("o_orderpriority").alias("title"))
    return S.review_list(rows, "reference", ["title"])


@query("s15_batch_summary", "SELECT o_orderdate::VARCHAR AS day, o_orderkey, o_orderstatus FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def s15_summary(spark, sf):
    """The orders of the last day, written as the summary of a batch and read back."""
    rows = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    path = shared_path(spark, "batch-summary")
    S.write_batch_summary(rows, "day", ["o_orderkey", "o_orderstatus"], path)
    return spark.read.schema("day string, o_orderkey long, o_orderstatus string").json(path)


@query("s17_rule_load", "SELECT p_partkey, split_part(p_name, ' ', 1) AS terms FROM part")
def s17(spark, sf):
    """Rules made of the first words of part names, loaded and applied to the names."""
    part = table(spark, sf, "part")
    words = part.select(F.split("p_name", " ")[0].alias("pattern")).distinct()  # a few adjectives
    rules = R.load_rules(words.select(F.lit("product").alias("rule_set"), F.lit(1).alias("step"), F.col("pattern").alias("label"), "pattern"))
    return part.select("p_partkey", F.array_join(R.terms_found(F.col("p_name"), rules.product_terms), ",").alias("terms"))


# ---- versioned sinks


def _order_rows(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("work"), "o_totalprice")


@query(
    "s12_versioned_upsert",
    """WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'in-progress' END AS work, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders),
o AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'in-progress' END AS work, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT 2 AS version, id, status, work, o_totalprice FROM n WHERE id % 2 = 0 OR id % 3 = 0 UNION ALL SELECT 1, * FROM o""",
)
def s12_versioned(spark, sf):
    """Two batches of orders on disk, each of them applied twice; both versions read back. The work status of an order survives."""
    rows = _order_rows(spark, sf)
    path = shared_path(spark, "orders-store")
    KeyedStore.create(spark, path, rows.schema, "id", 16)
    merge = lambda current, incoming: L.upsert(current, incoming, "id", ["work"])
    first = rows.filter("id % 2 = 0").withColumn("work", F.when(F.col("id") % 5 == 0, "in-progress"))
    second = rows.filter("id % 3 = 0").withColumns({"status": F.lit("done"), "o_totalprice": F.col("o_totalprice") + 1, "work": F.when((F.col("id") % 5 == 0), F.when(F.col("id") % 2 == 0, "new").otherwise("in-progress"))})
    for _ in range(2):
        KeyedStore(spark, path).upsert(first, merge, "portal", 0)
        KeyedStore(spark, path).upsert(second, merge, "portal", 1)
    found = KeyedStore(spark, path)
    return found.read().withColumn("version", F.lit(found.version)).unionByName(found.read(1).withColumn("version", F.lit(1)))


@query(
    "s11_write_once_store",
    """WITH e AS (SELECT user_id, event_id, event_id // (SELECT max(event_id) // 3 + 1 FROM events) AS batch FROM events), f AS (SELECT user_id, min(event_id) AS first FROM e GROUP BY 1)
SELECT e.user_id, event_id, batch::INT AS batch, CASE WHEN event_id = first THEN 'saved' ELSE 'exists' END AS outcome FROM e JOIN f ON e.user_id = f.user_id""",
)
def s11_store(spark, sf):
    """Three batches of events, each applied twice, into a table that keeps the first row of a user; what became of every row."""
    rows = table(spark, sf, "events").select("user_id", "event_id")
    third = rows.agg(F.floor(F.max("event_id") / 3) + 1).first()[0] or 1
    path = shared_path(spark, "first-store")
    KeyedStore.create(spark, path, rows.schema, "user_id", 16)
    found = []
    for n in range(3):
        part = rows.filter((F.col("event_id") >= n * third) & (F.col("event_id") < (n + 1) * third))
        for _ in range(2):
            last = KeyedStore(spark, path).append_first(part, "event_id", "events", n)
        found.append(last.withColumn("batch", F.lit(n)))
    return found[0].unionByName(found[1]).unionByName(found[2])


# ---- streams


def _paths(spark) -> tuple[str, str]:
    one = shared_path(spark, "stream")
    return f"{one}/out", f"{one}/checkpoint"


def _stream(spark, sf):
    """Events as a stream of files; times without a zone can't carry a watermark, so they become UTC times."""
    schema = table(spark, sf, "events").schema
    return J.files_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_incremental_ingest", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY 2, 3")
def st1(spark, sf):
    out, checkpoint = _paths(spark)
    rows = _stream(spark, sf).withColumn("key", F.concat_ws("-", _s("user_id"), "event_type"))
    J.ingest(rows, out, checkpoint, "key", "event_id").awaitTermination()
    return J.saved(spark, out).select("event_id", "user_id", "event_type")


@query("st2_streaming_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def st2(spark, sf):
    out, checkpoint = _paths(spark)
    rows = J.deduplicated(_stream(spark, sf), "ts", "40 days", "user_id", "event_type").select("user_id", "event_type")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query("st3_weekly_counts", "SELECT date_trunc('week', ts + INTERVAL 8 HOUR)::DATE AS week, count(*)::BIGINT AS n FROM events GROUP BY 1")
def st3(spark, sf):
    out, checkpoint = _paths(spark)
    J.keep_last(J.weekly_counts(_stream(spark, sf), "ts", "1 day"), out, checkpoint).awaitTermination()
    return J.last(spark, out).select((F.col("start") + F.expr("INTERVAL 8 HOURS")).cast("date").alias("week"), "n")


@query("st4_running_counters", "SELECT user_id % 10 AS scan, count(*)::BIGINT AS n, count_if(event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1")
def st4(spark, sf):
    out, checkpoint = _paths(spark)
    J.keep_last(J.running_counts(_stream(spark, sf), F.col("user_id") % 10, errors=F.col("event_type") == "error"), out, checkpoint).awaitTermination()
    return J.last(spark, out)


@query(
    "st5_decision_state",
    """WITH v AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'product' WHEN 'error' THEN 'not relevant' WHEN 'view' THEN 'review' END AS d FROM events)
SELECT user_id, arg_max(d, (ts, event_id)) AS decision, max(event_id) AS event_id FROM v WHERE d IS NOT NULL GROUP BY 1""",
)
def st5(spark, sf):
    out, checkpoint = _paths(spark)
    spelled = F.when(F.col("event_type") == "click", "yes").when(F.col("event_type") == "error", "Not-Relevant").when(F.col("event_type") == "view", "review")
    J.decision_state(_stream(spark, sf).withColumn("word", spelled), out, checkpoint, "user_id", "word", "ts", "event_id").awaitTermination()
    return J.current(spark, out, "user_id").select("user_id", "decision", "event_id")


#: Titles of listed rows are types of events: errors are clearly negative, purchases products, the others open.
EVENT_RULES = R.RuleSet(product_terms=("purchase",), goods_terms=(), excluded=(("failure", "error"),))


def _landed(spark, sf, parts: int):
    """Events in files by event id, one after the other: yields the folder after each file has come."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, step = shared_path(spark, "landed"), (e.agg(F.floor(F.max("event_id") / parts) + 1).first()[0] or 1)
    for n in range(parts):
        e.filter((F.col("event_id") >= n * step) & (F.col("event_id") < (n + 1) * step)).coalesce(1).write.mode("append").parquet(folder)
        yield folder, e.schema


@query(
    "st1_planned_ingest",
    """WITH s AS (SELECT user_id, min(event_id) FILTER (WHERE event_type <> 'error') AS first FROM events WHERE user_id % 10 > 1 GROUP BY 1)
SELECT event_id, e.user_id, CASE WHEN e.user_id % 10 = 0 THEN 'reuse' WHEN event_type = 'error' THEN 'skip' WHEN e.user_id % 10 = 1 OR event_id <> first THEN 'reuse' ELSE 'process' END AS plan,
  first AS saved_event, CASE WHEN e.user_id % 10 <= 1 THEN 'not relevant' ELSE (SELECT CASE event_type WHEN 'purchase' THEN 'product' ELSE 'review' END FROM events x WHERE x.event_id = s.first) END AS label
FROM events e LEFT JOIN s ON e.user_id = s.user_id""",
)
def st1_planned(spark, sf):
    """Three files of listed rows, the stream stopped and started again between them: the plan of each row and what is saved for its key."""
    plans, checkpoint = _paths(spark)
    store = shared_path(spark, "scan-store")
    seed = table(spark, sf, "events").filter("user_id % 10 < 2").select("user_id").distinct().select(
        "user_id", F.lit(None).cast("long").alias("saved_event"), F.lit("not relevant").alias("label"), (F.col("user_id") % 10 == 0).alias("is_manual"), (F.col("user_id") % 10 == 1).alias("reusable")
    )
    KeyedStore.create(spark, store, seed.schema, "user_id", 16).upsert(seed, lambda current, incoming: incoming, "seed", 0)

    def process(rows):
        found = C.classify(rows, "event_type", EVENT_RULES)
        return found.select("user_id", F.col("event_id").alias("saved_event"), C.label(F.col("relevance")).alias("label"), F.lit(False).alias("is_manual"), F.lit(True).alias("reusable"))

    for folder, schema in _landed(spark, sf, 3):
        J.planned_ingest(J.files_stream(spark, folder, schema), store, plans, checkpoint, "event_type", "event_id", EVENT_RULES, process, []).awaitTermination()
    kept = KeyedStore(spark, store).read().select("user_id", "saved_event", "label")
    return J.saved(spark, plans).select("event_id", "user_id", "plan").join(kept, "user_id", "left")


@query(
    "st3_weekly_groups",
    """WITH e AS (SELECT date_trunc('week', ts + INTERVAL 8 HOUR)::DATE AS week, user_id, min(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END) AS kind FROM events WHERE user_id % 11 > 0 GROUP BY 1, 2),
m AS (SELECT max(ts) AS last FROM events)
SELECT week, count_if(kind = 0)::BIGINT AS new, count_if(kind = 1)::BIGINT AS saved, count_if(kind = 2)::BIGINT AS unknown FROM e, m WHERE week + INTERVAL 7 DAY - INTERVAL 8 HOUR <= last - INTERVAL 1 DAY GROUP BY 1""",
)
def st3_groups(spark, sf):
    """The weeks that have closed, counted by their best kind of each user, as the weekly report has them."""
    out, checkpoint = _paths(spark)
    rows = _stream(spark, sf).withColumn("ident", F.when(F.col("user_id") % 11 > 0, F.col("user_id")))
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    J.appended(J.weekly_groups(rows, "ts", "1 day", "ident", kind), out, checkpoint).awaitTermination()
    found = J.saved(spark, out)
    return found.select((F.col("start") + F.expr("INTERVAL 8 HOURS")).cast("date").alias("week"), "new", "saved", "unknown")


@query(
    "st4_observed_progress",
    """SELECT count(*)::BIGINT AS n, count_if(event_type = 'error')::BIGINT AS errors, count_if(event_type = 'purchase')::BIGINT AS product, 4::BIGINT AS batches FROM events""",
)
def st4_observed(spark, sf):
    """Counters that left the batches of a running stream while it wrote something else."""
    out, checkpoint = _paths(spark)
    for folder, schema in _landed(spark, sf, 4):
        pass
    t = F.col("event_type")
    rows = J.observed(J.files_stream(spark, folder, schema, files_per_batch=1), "scan", errors=t == "error", product=t == "purchase")
    with J.progress(spark, "scan") as seen:
        seen.follow(rows.select("event_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return spark.createDataFrame([(*(seen.totals.get(k, 0) for k in ("n", "errors", "product")), len(seen.history))], "n long, errors long, product long, batches long")


_COMMANDS = """(SELECT user_id AS key, event_id, ts, CASE event_type WHEN 'click' THEN 'product' WHEN 'error' THEN 'not relevant' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'review' END END AS decision,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'in-progress' END END AS status, event_type = 'signup' AND event_id % 2 = 0 AS is_read, event_type = 'signup' AND event_id % 2 = 1 AS is_review FROM events)"""


@query(
    "st5_lifecycle_state",
    f"""SELECT key, arg_max(decision, (ts, event_id)) FILTER (WHERE decision IS NOT NULL) AS decision, max(ts) FILTER (WHERE decision IS NOT NULL) AS decided_at, arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS work_status,
min(ts) FILTER (WHERE is_read) AS first_read, min(ts) FILTER (WHERE is_review OR decision IS NOT NULL) AS first_review FROM {_COMMANDS} GROUP BY 1
HAVING count_if(decision IS NOT NULL OR status IS NOT NULL OR is_read OR is_review) > 0""",
)
def st5_lifecycle(spark, sf):
    """Decision, work status, first read and first review of each user, merged by key over three files and restarts."""
    checkpoint = shared_path(spark, "lifecycle")
    store = shared_path(spark, "lifecycle-store")
    made = False
    for folder, schema in _landed(spark, sf, 3):
        t, n = F.col("event_type"), F.col("event_id")
        op = F.when(t == "purchase", "work_status").when(t == "signup", F.when(n % 2 == 0, "read").otherwise("review")).otherwise("decide")
        said = F.when(t == "click", "YES").when(t == "error", "not_relevant").when((t == "view") & (n % 2 == 0), "unsure").when(t == "purchase", F.when(n % 3 == 0, "Finished").when(n % 3 == 1, "in progress").otherwise("?"))
        rows = J.files_stream(spark, folder, schema).withColumns({"op": op, "said": said})
        commands = J.lifecycle_commands(rows, "user_id", "op", "said", "ts", "event_id")
        if not made:
            made = bool(KeyedStore.create(spark, store, StructType.fromDDL(f"key bigint, {J.LIFECYCLE}"), "key", 16))
        J.lifecycle_state(commands, store, checkpoint, idle_days=5).awaitTermination()
    zone_free = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return KeyedStore(spark, store).read().select("key", "decision", zone_free("decided_at"), "work_status", zone_free("first_read"), zone_free("first_review"))
