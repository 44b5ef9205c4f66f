"""Filters, joins, aggregates, windows, limits and set operations over notices.

Every function takes its tables and the names of their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import local_week

# ---- filters and projections


def first_per_key(df: DataFrame, key: str | list[str], *order: str | Column) -> DataFrame:
    """The first row of each key by ``order``; null keys are one key."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def in_mode_and_window(df: DataFrame, key: str, order: str, mode_col: str, mode: str, day_col: str, start: str, end: str) -> DataFrame:
    """Rows of a mode (contained, any case) published from ``start`` to ``end``, the first of each key."""
    day = F.col(day_col).cast("date")
    chosen = F.lower(mode_col).contains(mode.lower()) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return first_per_key(df.filter(chosen), key, order)


def latest(df: DataFrame, key: str, order: str, n: int, condition: Column) -> DataFrame:
    """The first ``n`` distinct keys that meet a condition, in list order."""
    if not isinstance(n, int) or n < 1:
        raise ValueError("n is a whole number of 1 or more")
    return first_per_key(df.filter(condition), key, order).orderBy(order).limit(n)


def faceted(
    df: DataFrame, *, portal: str | None = None, label: str | None = None, work_status: str | None = None,
    start: str | None = None, end: str | None = None, search: str | None = None, columns: dict[str, str] | None = None,
) -> DataFrame:
    """All facets that are given must hold.

    ``columns`` maps portal, label, work_status, day and (comma-separated)
    search to column names. ``work_status`` counts for products only, and
    ``active`` is anything but done. Rows without a day drop out when a range
    is given. Null parts of the searched text are empty.
    """
    c = {"portal": "portal", "label": "label", "work_status": "work_status", "day": "day", "search": "reference,title,organization"} | (columns or {})
    out = df
    if start or end:
        day = F.col(c["day"]).cast("date")
        out = out.filter(day.isNotNull())
        out = out.filter(day >= F.lit(start).cast("date")) if start else out
        out = out.filter(day <= F.lit(end).cast("date")) if end else out
    if portal:
        out = out.filter(F.col(c["portal"]) == portal)
    if label:
        out = out.filter(F.col(c["label"]) == label)
    if work_status and label == "product":
        status = F.coalesce(F.col(c["work_status"]), F.lit("new"))
        out = out.filter(status != "done" if work_status == "active" else status == work_status)
    if search and search.strip():
        text = F.concat_ws(" ", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c["search"].split(",")))
        out = out.filter(F.lower(text).contains(search.strip().lower()))
    return out


def public_columns(df: DataFrame, columns: list[str], url_col: str, key_col: str, prefix: str) -> DataFrame:
    """P5: the columns that a restricted role sees; a url elsewhere is rebuilt from the key."""
    url = F.when(F.col(url_col).startswith(prefix), F.col(url_col)).otherwise(F.concat(F.lit(prefix), F.col(key_col).cast("string")))
    return df.select(*columns, url.alias(url_col))


def evidence_text(df: DataFrame, fields: dict[str, str], items_col: str | None = None, item_fields: dict[str, str] | None = None) -> Column:
    """Lines ``Label: value`` of the fields and of all items, blanks left out."""

    def line(name: str, value: Column) -> Column:
        text = F.trim(value.cast("string"))
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{name}: "), text))

    lines = [line(name, F.col(c)) for name, c in fields.items()]
    if items_col:
        of_item = lambda x: F.array_compact(F.array(*(line(n, x[c]) for n, c in (item_fields or {}).items())))
        lines.append(F.nullif(F.array_join(F.flatten(F.transform(F.coalesce(F.col(items_col), F.array().cast(df.schema[items_col].dataType)), of_item)), "\n"), F.lit("")))
    return F.concat_ws("\n", *lines)


SECRET = "(?i)(password|passwd|secret|token|api_?key|cookie|session)"


def validated(df: DataFrame, key: str, rules: dict[str, Column], allowed: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and rejects ``key, errors``.

    ``rules`` are named conditions; null is a failure. Columns that look like
    secrets, or aren't ``allowed``, reject the whole table by raising.
    """
    import re

    if bad := [c for c in df.columns if re.search(SECRET, c) or (allowed is not None and c not in allowed)]:
        raise ValueError(f"columns not accepted: {bad}")
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    marked = df.withColumn("__errors", failed)
    return marked.filter(F.size("__errors") == 0).drop("__errors"), marked.filter(F.size("__errors") > 0).select(key, F.col("__errors").alias("errors"))


# ---- joins


def unread(notices: DataFrame, reads: DataFrame, key: str, baseline: bool = True) -> DataFrame:
    """``notices`` with ``unread``: a baseline is recorded and no read is."""
    seen = reads.select(F.col(key).alias("__k"), F.lit(True).alias("__seen")).distinct()
    return notices.join(seen, F.col(key) == F.col("__k"), "left").withColumn("unread", F.lit(baseline) & F.col("__seen").isNull()).drop("__k", "__seen")


def overlay(snapshot: DataFrame, current: DataFrame, key: str, columns: dict[str, str], found_col: str = "found") -> DataFrame:
    """``snapshot`` with current values laid over it, and whether there was a current row.

    ``columns`` maps a column of the snapshot to one of the current table;
    a current value that is null or empty leaves the stored one.
    """
    side = current.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__c_{c}") for c in set(columns.values())), F.lit(True).alias("__found"))
    joined = snapshot.join(side, F.col(key) == F.col("__k"), "left")
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    new = {s: F.when(text(f"__c_{c}").isNotNull(), F.col(f"__c_{c}")).otherwise(F.col(s)) for s, c in columns.items()}
    return joined.withColumns(new).withColumn(found_col, F.coalesce("__found", F.lit(False))).drop("__k", "__found", *(f"__c_{c}" for c in set(columns.values())))


def overview(notices: DataFrame, records: DataFrame, key: str, outcome: str = "outcome", absent: str = "never") -> DataFrame:
    """Every notice with its record's outcome, or ``absent``."""
    side = records.select(F.col(key).alias("__k"), F.col(outcome).alias("__o"))
    return notices.join(side, F.col(key) == F.col("__k"), "left").withColumn(outcome, F.coalesce("__o", F.lit(absent))).drop("__k", "__o")


def exact_awards(awards: DataFrame, wanted: DataFrame, reference: str, number: str, most: int = 25) -> DataFrame:
    """Award rows of exactly the wanted references, each number once, up to ``most`` of a reference, with ``truncated``."""
    refs = wanted.select(F.col(reference).alias("__r")).distinct()
    once = first_per_key(awards.join(refs, F.col(reference) == F.col("__r"), "left_semi"), [reference, number], number)
    per = Window.partitionBy(reference)
    counted = once.withColumn("__n", F.row_number().over(per.orderBy(number))).withColumn("truncated", F.count("*").over(per) > most)
    return counted.filter(F.col("__n") <= most).drop("__n")


def checked_details(listed: DataFrame, details: DataFrame, reference: str, number: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Details over list values, and conflicts where the detail names another reference."""
    side = details.select(F.col(number).alias("__n"), F.col(reference).alias("__r"), *(F.col(v).alias(f"__d_{v}") for v in values))
    both = listed.join(side, F.col(number) == F.col("__n"), "left")
    odd = F.col("__r").isNotNull() & (F.col("__r") != F.col(reference))
    drop = ["__n", "__r", *(f"__d_{v}" for v in values)]
    good = both.filter(~F.coalesce(odd, F.lit(False))).withColumns({v: F.coalesce(f"__d_{v}", v) for v in values}).drop(*drop)
    return good, both.filter(odd).select(reference, number, F.col("__r").alias("detail_reference"))


def taken_elsewhere(rows: DataFrame, stored: DataFrame, number: str, key: str) -> DataFrame:
    """Rows whose number is stored under another key."""
    side = stored.select(F.col(number).alias("__n"), F.col(key).alias("__k"))
    return rows.join(side, (F.col(number) == F.col("__n")) & (F.col(key) != F.col("__k")), "left_semi")


def notice_summary(notices: DataFrame, columns: list[str], label: str, work_status: str, portal: str, product: str = "product", legacy: str = "legacy") -> DataFrame:
    """Summary columns, the public status (of products alone, new by default) and whether the portal needs a login."""
    status = F.when(F.col(label) == product, F.coalesce(work_status, F.lit("new")))
    return notices.select(*columns, label, status.alias("public_status"), portal, (F.col(portal) == legacy).alias("login_required"))


def reusable(has_requirements: Column, has_relevance: Column, label: Column) -> Column:
    """P10: whether a saved packet can be reused: it has requirements and relevance, and a label. Never null."""
    return F.coalesce(has_requirements & has_relevance & label.isNotNull(), F.lit(False))


def as_field(value: Column, record: bool = False) -> Column:
    """A provenance record as it is (``record``), or a plain value as one whose source and confidence aren't recorded; blank ones are null."""
    text = F.nullif(F.trim((value["value"] if record else value).cast("string")), F.lit(""))
    source = value["source"] if record else F.lit(None).cast("string")
    confidence = F.coalesce(value["confidence"], F.lit("not recorded")) if record else F.lit("not recorded")
    return F.when(text.isNotNull(), F.struct(text.alias("value"), source.alias("source"), confidence.alias("confidence")))


def case_report(notices: DataFrame, items: DataFrame, key: str, item_key: str, quantity: str, fields: dict[str, Column], reviewed: Column) -> DataFrame:
    """One wide row per notice: its fields as records, number and quantity of items, reviewed as true, false or unknown.

    Fields that are structs with ``value``, ``source`` and ``confidence`` keep them.
    """
    sums = items.groupBy(F.col(item_key).alias("__k")).agg(F.count("*").alias("n_items"), F.sum(quantity).alias("quantity"))
    rows = notices.join(sums, F.col(key) == F.col("__k"), "left")
    kinds = rows.select(*(c.alias(n) for n, c in fields.items())).dtypes
    records = [as_field(fields[n], kind.startswith("struct")).alias(n) for n, kind in kinds]
    return rows.select(key, *records, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"), reviewed.alias("reviewed"))


def whole_case_report(
    notices: DataFrame, key: str, plain: dict[str, Column], fields: dict[str, Column], reviewed: Column, items: DataFrame, item_order: str, item_fields: dict[str, Column],
    facts: DataFrame, documents: DataFrame, conflicts: DataFrame, clauses: DataFrame, emails: Column,
) -> DataFrame:
    """P11 in full: one wide row per notice, with lists of what belongs to it.

    ``plain`` columns are trimmed texts, ``fields`` and ``item_fields`` become
    records (``as_field``). ``facts`` (E20: place, label, value, source_label),
    ``documents`` (number, name), ``conflicts`` (field, value, source) and
    ``clauses`` have rows by key; clauses are counted. ``emails`` is the array
    of candidates. A notice without requirements has empty lists, null
    records and ``has_requirements`` false: nothing is made up for it.
    """

    def listed(rows: DataFrame, called: str, *order: Column, **columns: Column) -> DataFrame:
        entry = F.struct(F.struct(*order).alias("__at"), F.struct(*(c.alias(n) for n, c in columns.items())).alias("__x"))
        gathered = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["__x"])
        return rows.groupBy(F.col(key).alias("__k")).agg(gathered.alias(called))

    kinds = dict(items.select(*(c.alias(n) for n, c in item_fields.items())).dtypes)
    records = {n: as_field(c, kinds[n].startswith("struct")) for n, c in item_fields.items()}
    lists = [
        listed(items, "items", F.col(item_order), **records),
        listed(facts, "facts", F.col("place"), label=F.col("label"), value=F.col("value"), source_label=F.col("source_label")),
        listed(documents, "documents", F.col("number"), name=F.col("name")),
        listed(conflicts, "conflicts", F.col("field"), F.col("source"), field=F.col("field"), value=F.col("value"), source=F.col("source")),
        clauses.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n_clauses")),
    ]
    own = notices.select(*(c.alias(n) for n, c in fields.items())).dtypes
    texts = [F.nullif(F.trim(c.cast("string")), F.lit("")).alias(n) for n, c in plain.items()]
    out = notices.select(key, *texts, *(as_field(fields[n], kind.startswith("struct")).alias(n) for n, kind in own), emails.alias("email_candidates"), reviewed.alias("reviewed"))
    for side in lists:
        name = side.columns[1]
        empty = F.lit(0).cast("long") if name == "n_clauses" else F.array().cast(side.schema[name].dataType)
        out = out.join(side, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, empty))
    return out.withColumn("has_requirements", (F.size("items") > 0) | (F.size("facts") > 0) | (F.col("n_clauses") > 0))


def with_defaults(df: DataFrame, key: str, texts: dict[str, Column], nullable: dict[str, Column], lists: dict[str, Column]) -> DataFrame:
    """A packet's fixed shape: texts default to the empty string, others to null, lists to the empty list."""
    return df.select(
        key, *(F.coalesce(c, F.lit("")).alias(n) for n, c in texts.items()), *(c.alias(n) for n, c in nullable.items()),
        *(F.coalesce(F.array_compact(c), F.array().cast("array<string>")).alias(n) for n, c in lists.items()),
    )


def planned_rows(rows: DataFrame, state: DataFrame, row_key: str, key: str, clear_negative: Column) -> DataFrame:
    """Rows with ``plan``: a manual decision is reused, a clear negative skipped, a reusable result reused, the rest processed."""
    known = state.select(F.col(key).alias("__key"), F.col("is_manual").alias("__manual"), F.col("reusable").alias("__reusable"))
    plan = F.when(F.coalesce("__manual", F.lit(False)), "reuse").when(clear_negative, "skip").when(F.coalesce("__reusable", F.lit(False)), "reuse").otherwise("process")
    return rows.join(known, F.col(row_key) == F.col("__key"), "left").withColumn("plan", plan).drop("__key", "__manual", "__reusable")


# ---- aggregates


def count_by_label(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """A1: one row: all, and the rows of each label."""
    return df.agg(F.count("*").alias("all"), *(F.count_if(F.col(label) == x).alias(x.replace(" ", "_")) for x in labels))


def outcome_counts(rows: DataFrame, scan: str, key: str, order: str, buckets: dict[str, Column], downloads: str, reused: Column) -> DataFrame:
    """A2: per scan, each distinct key in the first bucket that fits, and the downloads of rows that aren't reused.

    Rows without a key aren't counted; the first row of a key counts.
    """
    once = first_per_key(rows.filter(F.col(key).isNotNull()), [scan, key], order)
    bucket = F.coalesce(*(F.when(c, F.lit(n)) for n, c in buckets.items()), F.lit("other"))
    marked = once.withColumn("__b", bucket)
    return marked.groupBy(scan).agg(
        F.count("*").alias("discovered"),
        *(F.count_if(F.col("__b") == n).alias(n) for n in (*buckets, "other")),
        F.coalesce(F.sum(F.when(~reused, F.col(downloads))), F.lit(0)).alias("downloads"),
    )


def coverage_sum(df: DataFrame, value: str, *by: str) -> DataFrame:
    """A5: total, rows with a number and rows without; a total of no numbers is null."""
    x = F.col(value).try_cast("double")
    return df.groupBy(*by).agg(F.sum(x).alias("total"), F.count(x).alias("recorded"), (F.count("*") - F.count(x)).alias("missing"))


def scan_listed(rows: DataFrame, scan: str, identity: Column, order: str, is_product: Column, known: Column, title: str, error: Column) -> DataFrame:
    """A4: the product rows that a scan's report lists: ``scan, order, identity, title, previously_saved``.

    Rows with an error are passed over, products or not. Rows of one identity are listed once, the first by ``order``; those without an identity are all listed.
    """
    item = [F.col(order), identity.alias("identity"), F.col(title).alias("title"), F.coalesce(known, F.lit(False)).alias("previously_saved")]
    found = rows.filter(is_product & error.isNull()).select(scan, *item)
    named = found.filter("identity IS NOT NULL").groupBy(scan, "identity").agg(F.min_by(F.struct(order, "title", "previously_saved"), order).alias("__first"))
    return named.select(scan, f"__first.{order}", "identity", "__first.title", "__first.previously_saved").unionByName(found.filter("identity IS NULL"))


def scan_errors(rows: DataFrame, scan: str, order: str, error: Column, stopped: Column | None = None) -> DataFrame:
    """A4: the messages of a scan: ``scan, order, message``.

    ``stopped`` is what ended the scan as a whole, the same in all of its
    rows; it is a message (with a null ``order``) if no row has an error.
    """
    found = rows.select(scan, order, error.alias("message")).filter("message IS NOT NULL")
    if stopped is None:
        return found
    whole = rows.groupBy(scan).agg(F.count(error).alias("__n"), F.max(stopped).alias("message")).filter("__n = 0 AND message IS NOT NULL")
    return found.unionByName(whole.select(scan, F.lit(None).cast(rows.schema[order].dataType).alias(order), "message"))


def scan_report(rows: DataFrame, scan: str, identity: Column, order: str, is_product: Column, known: Column, error: Column, title: str, stopped: Column | None = None) -> DataFrame:
    """A4: one row per scan with its counts; ``scan_listed`` and ``scan_errors`` give what is counted, as rows.

    Lists grow with the scan, so they aren't collected into its row.
    """
    listed = scan_listed(rows, scan, identity, order, is_product, known, title, error).groupBy(F.col(scan).alias("__scan")).agg(
        F.count("*").alias("listed"), F.count_if("previously_saved").alias("previously_saved")
    )
    whole = F.when((F.count(error) == 0) & F.max(stopped).isNotNull(), 1).otherwise(F.count(error)) if stopped is not None else F.count(error)
    counts = rows.groupBy(scan).agg(F.count("*").alias("discovered"), F.count_if(is_product).alias("products"), whole.cast("long").alias("errors"))
    return counts.join(listed, F.col(scan).eqNullSafe(F.col("__scan")), "left").drop("__scan").fillna(0, ["listed", "previously_saved"])


def weekly_groups(rows: DataFrame, started: str, identity: str, kind: Column, order: str, title: str, zone: str = "Asia/Manila") -> DataFrame:
    """Per local week and identity the best kind (0 new, 1 saved, 2 unknown), its title, and how often it came.

    The first row by scan, then ``order``, gives the title; the first new row
    after it replaces it unless its own is blank. Rows without an identity
    aren't grouped.
    """
    rows = rows.withColumn("week", local_week(F.col(started), zone)).withColumn("__kind", kind).filter(F.col(identity).isNotNull())
    place, named = F.struct(started, order), F.nullif(F.trim(title), F.lit(""))
    found = rows.groupBy("week", identity).agg(
        F.min("__kind").alias("kind"), F.min(started).alias("first_seen"), F.count("*").alias("seen"),
        F.min_by(F.struct("__kind", named.alias("t")), place).alias("__first"), F.min_by(F.struct(named.alias("t")), F.when(F.col("__kind") == 0, place)).alias("__new"),
    )
    chosen = F.when(F.col("__first.__kind") == 0, F.col("__first.t")).otherwise(F.coalesce("__new.t", "__first.t"))
    return found.select("week", identity, "kind", chosen.alias("title"), "first_seen", "seen")


def weekly_state(groups: DataFrame, packets: DataFrame, identity: str, key: str, fields: dict[str, str], work_status: str) -> DataFrame:
    """Weekly groups with fields of their saved packet, null where there is none; only new groups have a status."""
    side = packets.select(F.col(key).alias("__k"), F.col(work_status).alias("__status"), *(F.col(c).alias(f"__f_{n}") for n, c in fields.items()))
    rows = groups.join(side, F.col(identity) == F.col("__k"), "left")
    status = F.when(F.col("kind") == 0, F.coalesce("__status", F.lit("not recorded")))
    return rows.select("week", identity, "kind", *(F.col(f"__f_{n}").alias(n) for n in fields), status.alias("status"))


def weekly_report(rows: DataFrame, started: str, identity: str, kind: Column, order: str, title: str, complete: Column, legacy: Column, zone: str = "Asia/Manila") -> DataFrame:
    """Per local week: scans complete, incomplete and not recorded, groups of each kind, rows without identity, source label."""
    groups = weekly_groups(rows, started, identity, kind, order, title, zone).groupBy("week").agg(
        F.count_if(F.col("kind") == 0).alias("new"), F.count_if(F.col("kind") == 1).alias("saved"), F.count_if(F.col("kind") == 2).alias("unknown")
    )
    runs = rows.withColumn("week", local_week(F.col(started), zone)).groupBy("week").agg(
        F.count_if(complete).alias("complete"), F.count_if(~complete).alias("incomplete"), F.count_if(complete.isNull()).alias("not_recorded"),
        F.count_if(F.col(identity).isNull()).alias("without_identity"), F.when(F.bool_and(legacy), "legacy").otherwise("mixed or current").alias("source"),
    )
    return runs.join(groups, "week", "left").fillna(0, ["new", "saved", "unknown"])


WORK_STATUSES = ("new", "in-progress", "done")


def weekly_status(groups: DataFrame, packets: DataFrame, identity: str, key: str, work_status: str) -> DataFrame:
    """Per week the new groups by the current work status of their packets: ``week, new_status, in_progress, done, not_recorded``.

    Weeks without a new group aren't listed; a status that isn't one of
    ``WORK_STATUSES``, and a group without a packet, is not recorded.
    """
    rows = weekly_state(groups, packets, identity, key, {}, work_status).filter("kind = 0")
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("week").agg(n("new").alias("new_status"), n("in-progress").alias("in_progress"), n("done").alias("done"), F.count_if(~F.col("status").isin(*WORK_STATUSES)).alias("not_recorded"))


def weekly_errors(rows: DataFrame, scan: str, started: str, order: str, reference: Column, error: Column, stopped: Column | None = None, zone: str = "Asia/Manila") -> DataFrame:
    """The messages of a week's scans: ``week, scan, started_at, reference, message``, as A4 reports them; a scan's start is its first."""
    of_scan = rows.groupBy(F.col(scan).alias("__s")).agg(F.min(started).alias("started_at"))
    named = rows.select(F.col(scan).alias("__n"), F.col(order).alias("__o"), reference.alias("reference"))
    found = scan_errors(rows, scan, order, error, stopped).join(of_scan, F.col(scan).eqNullSafe(F.col("__s")))
    found = found.join(named, F.col(scan).eqNullSafe(F.col("__n")) & (F.col(order) == F.col("__o")), "left")
    return found.select(local_week(F.col("started_at"), zone).alias("week"), scan, "started_at", F.nullif(F.trim(F.col("reference").cast("string")), F.lit("")).alias("reference"), "message")


def transition_matrix(df: DataFrame, before: str, after: str) -> DataFrame:
    """How many rows go from each label to each."""
    return df.groupBy(before, after).agg(F.count("*").alias("n"))


def moved(df: DataFrame, before: str, after: str, key: str, title: str, reason: str, most: int = 160) -> DataFrame:
    """The rows whose label changes, one each, with the start of the title and the reason."""
    return df.filter(F.col(before) != F.col(after)).select(before, after, key, F.substring(title, 1, most).alias("title"), F.col(reason).alias("reason"))


def reclassify_counts(rows: DataFrame, by: str, error: Column, manual: Column, label: Column, inspected: Column, downloaded: Column) -> DataFrame:
    """A3: per run what was examined: errors, else manual ones, else the reclassified by label; inspections and downloads of all."""
    done = ~error & ~manual
    return rows.groupBy(by).agg(
        F.count("*").alias("examined"), F.count_if(error).alias("errors"), F.count_if(~error & manual).alias("manual"), F.count_if(done).alias("reclassified"),
        *(F.count_if(done & (label == n)).alias(n.replace(" ", "_")) for n in ("product", "review", "not relevant")),
        F.count_if(inspected).alias("inspected"), F.count_if(downloaded).alias("downloaded"),
    )


def award_summary(awards: DataFrame, pending: Column, published: Column, amount: str) -> DataFrame:
    """One row: awards, pending, accepted, and the exact total of the published ones."""
    total = F.sum(F.when(published, F.col(amount).cast("decimal(18,2)"))).cast("decimal(28,2)")
    return awards.agg(F.count("*").alias("n"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("accepted"), total.alias("total"))


def outcome_totals(records: DataFrame, outcome: str, checked_at: str, outcomes: dict[str, str], never: str) -> DataFrame:
    """One row: records, those of each outcome, never checked, checked, and the last check."""
    o = F.col(outcome)
    return records.agg(
        F.count("*").alias("n"), *(F.count_if(o == v).alias(n) for n, v in outcomes.items()), F.count_if(o == never).alias("never"),
        (F.count("*") - F.count_if(o == never)).alias("checked"), F.max(F.when(o != never, F.col(checked_at))).alias("last_check"),
    )


def run_statistics(rows: DataFrame, run: str, key: str, order: str, page: Column, counters: dict[str, Column], stop_reason: Column) -> DataFrame:
    """A10: per run its counters over the first row of each key, what came again, pages, errors and the first reason to stop.

    ``counters`` should name the flags inspected, small_value, classified,
    saved, already_saved, product, not_relevant, review and errors.
    """
    flags = F.struct(*(c.alias(n) for n, c in counters.items()))
    keys = rows.groupBy(run, key).agg(F.count("*").alias("__n"), F.min_by(flags, order).alias("__first"))
    counts = keys.groupBy(run).agg(
        F.sum("__n").alias("listed"), (F.sum("__n") - F.count("*")).alias("duplicates_skipped"), *(F.count_if(F.col(f"__first.{n}")).alias(n) for n in counters)
    )
    stops = rows.groupBy(F.col(run).alias("__run")).agg(F.count_distinct(page).alias("pages_visited"), F.min_by(stop_reason, F.when(stop_reason.isNotNull(), F.col(order))).alias("stop_reason"))
    return counts.join(stops, F.col(run).eqNullSafe(F.col("__run"))).drop("__run").withColumn("stopped", F.col("stop_reason").isNotNull())


# ---- windows, order, limits, sets


def latest_first(df: DataFrame, at: str, key: str) -> DataFrame:
    """By time, latest first, then by key, largest first."""
    return df.orderBy(F.desc(at), F.desc(key))


def repeated_pages(rows: DataFrame, scan: str, page: str, identity: str) -> DataFrame:
    """Per page its ids, and whether they are those of the page before it."""
    pages = rows.groupBy(scan, page).agg(F.array_join(F.sort_array(F.collect_list(F.col(identity).cast("string"))), ",").alias("fingerprint"))
    before = F.lag("fingerprint").over(Window.partitionBy(scan).orderBy(page))
    return pages.withColumn("repeated", F.coalesce(F.col("fingerprint") == before, F.lit(False)))


def listing_coverage(rows: DataFrame, pages: DataFrame, scan: str, page: str, identity: str, day: str, start: str, ceiling: int = 200) -> DataFrame:
    """Per scan the pages read, rows kept, the reason to stop and whether that is complete.

    ``pages`` lists the pages of each scan, empty ones too. A walk stops at an
    empty page, at one that repeats the page before, after one whose days are
    all before ``start``, or at the ceiling.
    """
    prints = repeated_pages(rows, scan, page, identity).withColumnsRenamed({scan: "__s", page: "__p"})
    days = rows.groupBy(F.col(scan).alias("__s2"), F.col(page).alias("__p2")).agg(F.max(F.col(day).cast("date")).alias("last_day"), F.count("*").alias("n"))
    walk = pages.join(prints, (F.col(scan) == F.col("__s")) & (F.col(page) == F.col("__p")), "left").join(
        days, (F.col(scan) == F.col("__s2")) & (F.col(page) == F.col("__p2")), "left"
    )
    order = Window.partitionBy(scan).orderBy(page)
    reason = (
        F.when(F.col("n").isNull(), "empty-page")
        .when(F.col("repeated"), "repeated-page")
        .when(F.col("last_day") < F.lit(start).cast("date"), "date-boundary")
        .when(F.row_number().over(order) >= ceiling, "safety-limit")
    )
    walk = walk.withColumn("reason", reason).withColumn("place", F.row_number().over(order))
    stop = walk.groupBy(scan).agg(F.min(F.when(F.col("reason").isNotNull(), F.col("place"))).alias("stop"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("place"))).alias("reason"))
    keep = walk.join(stop.withColumnsRenamed({scan: "__k", "reason": "stop_reason"}), F.col(scan) == F.col("__k"))
    read = keep.filter(F.col("stop").isNull() | (F.col("place") <= F.col("stop")))
    counted = F.when(F.col("reason").isin("empty-page", "repeated-page"), 0).otherwise(F.col("n"))
    return read.groupBy(scan).agg(
        F.count("*").alias("pages_read"), F.coalesce(F.sum(counted), F.lit(0)).alias("rows_kept"), F.coalesce(F.first("stop_reason"), F.lit("no-more-pages")).alias("reason"),
        F.coalesce(F.first("stop_reason").isin("empty-page", "date-boundary"), F.lit(False)).alias("complete"),
    )


def best_with_tie(df: DataFrame, key: str, score: str, order: str, sure: float) -> DataFrame:
    """The best row of each key, ``tied`` if another has its score and that is below ``sure``."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("__r", F.rank().over(w.orderBy(F.desc(score)))).filter("__r = 1").withColumn("__n", F.count("*").over(w))
    best = first_per_key(ranked, key, order)
    return best.withColumn("tied", (F.col("__n") > 1) & (F.col(score) < sure)).drop("__r", "__n")


def newest_first(df: DataFrame, day: str, order: str) -> DataFrame:
    """L1: newest day first, unknown days last, list order within a day."""
    return df.orderBy(F.col(day).desc_nulls_last(), F.col(order))


def featured(df: DataFrame, condition: Column, day: str, order: str, k: int = 5) -> DataFrame:
    """L2: the newest ``k`` rows that meet a condition."""
    return newest_first(df.filter(condition), day, order).limit(k)


def page_of(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """L3: a page of rows, counted from 1; pages beyond an end are the nearest one. Adds ``pages``."""
    if size not in (25, 40, 50, 100):
        raise ValueError("pages have 25, 40, 50 or 100 rows")
    pages = max(1, -(-df.count() // size))
    at = min(max(1, page), pages)
    return df.orderBy(*order).offset((at - 1) * size).limit(size).withColumn("pages", F.lit(pages))


def recheck_batch(df: DataFrame, overdue: Column, last_check: str, order: str, n: int = 8) -> DataFrame:
    """L4: what to check next: overdue first, never checked before long ago; 15 at most."""
    if not 1 <= n <= 15:
        raise ValueError("a batch has 1 to 15 rows")
    return df.orderBy(F.when(overdue, 0).otherwise(1), F.col(last_check).asc_nulls_first(), F.col(order)).limit(n)


def portal_union(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Notices of both portals; the same number on both is two notices."""
    return current.withColumn("portal", F.lit("current")).unionByName(legacy.withColumn("portal", F.lit("legacy")), allowMissingColumns=True)


def baseline_difference(present: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty if a given baseline is whole."""
    a, b = present.select(key).distinct(), given.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("unknown")))


def ordered_names(df: DataFrame, key: str, *lists: str) -> DataFrame:
    """The distinct names over several lists, in the order they are first seen."""
    return df.select(key, F.array_distinct(F.array_compact(F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists)))).alias("names"))
