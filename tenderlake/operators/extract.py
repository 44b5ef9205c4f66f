"""Requirement extraction from document text, with provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money
from ..functions.rules import matches
from ..functions.text import bind, capture, clean, field
from .lifecycle import completeness


def unwrap_lines(text: Column, block_start: str = r"^([0-9]+[.)]|[-*•]|[A-Z][A-Za-z ]{1,30}:)") -> Column:
    """Lines of a text, with a wrapped line joined to the one before it.

    A line starts anew if it opens a block, or if the one before ends with
    one of ``.:;!?``. Blank lines end a line as well.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        new = (acc["open"] == "") | line.rlike(block_start) | acc["open"].rlike(r"[.:;!?]$")
        closed = F.when(new & (acc["open"] != ""), F.array(acc["open"])).otherwise(F.array().cast("array<string>"))
        opened = F.when(new, line).otherwise(F.concat(acc["open"], F.lit(" "), line))
        blank = line == ""
        flush = F.when(acc["open"] != "", F.array(acc["open"])).otherwise(F.array().cast("array<string>"))
        return F.when(blank, F.struct(F.concat(acc["done"], flush).alias("done"), F.lit("").alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], closed).alias("done"), opened.alias("open"))
        )

    last = lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return F.aggregate(lines, start, step, last)


BIDDER = r"(?i)(bidder|signature|printed name|tin no|company name)"


def text_line_items(df: DataFrame, key: str, text_col: str, reach: int = 7, most: int = 300, bidder: str = BIDDER) -> DataFrame:
    """Item rows of a text table: ``key, item_no, item_reference, description, quantity, unit, amount, quote``.

    An item number of one or two digits stands alone on a line; one to
    ``reach - 1`` lines of description follow, then ``quantity unit amount``
    with two decimals. A line before the number that starts like ``2024-05-``
    is the item's reference. Blank lines don't count. Descriptions that are
    longer than ``most`` or name a field for bidders are no items.
    """
    total = r"^([0-9]+)\s+(\S+)\s+([0-9,]*[0-9]\.[0-9]{2})$"
    head = r"^[0-9]{1,2}$"
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    before = lambda ls, i: F.when(F.get(ls, i - 1).rlike("^[0-9]{4}-[0-9]{2}-"), F.get(ls, i - 1))
    followed = lambda ls: F.transform(ls, lambda s, i: F.when(s.rlike(head), F.struct(s.alias("line"), before(ls, i).alias("reference"), F.slice(ls, i + 2, reach).alias("after"))))
    heads = df.select(key, F.posexplode(F.filter(bind(lines, followed), lambda x: x.isNotNull())).alias("pos", "head")).select(key, "pos", "head.*")
    end = F.get(F.filter(F.transform("after", lambda s, i: F.when(s.rlike(total), i)), lambda i: i.isNotNull()), F.lit(0))
    found = heads.withColumn("end", end).filter("end >= 1")
    description = clean(F.array_join(F.slice("after", F.lit(1), F.col("end")), " "))
    part = lambda i: F.regexp_extract(F.get("after", F.col("end")), total, i)
    rows = found.select(
        key, "pos", F.col("line").cast("int").alias("item_no"), F.col("reference").alias("item_reference"), description.alias("description"),
        F.regexp_replace(part(1), ",", "").try_cast("double").alias("quantity"), part(2).alias("unit"), F.regexp_replace(part(3), ",", "").try_cast("decimal(18,2)").alias("amount"),
        F.array_join(F.concat(F.array("reference", "line"), F.slice("after", F.lit(1), F.col("end") + 1)), "\n").alias("quote"),
    )
    return rows.filter((F.length("description") <= most) & ~F.col("description").rlike(bidder)).drop("pos")


@dataclass(frozen=True)
class FieldRule:
    """Patterns of a field in order; the first with a plausible capture gives the value."""

    name: str
    patterns: tuple[str, ...]
    plausible: str | None = None


def first_capture(text: Column, rule: FieldRule) -> Column:
    """The first plausible capture of a field's patterns, cleaned."""
    found = [capture(text, p) for p in rule.patterns]
    return F.coalesce(*(F.when(x.rlike(rule.plausible), x) if rule.plausible else x for x in found))


#: Default rules for notices in English, written for this engine.
DEADLINE = FieldRule("deadline", (r"(?i)deadline\s+of\s+submission\s*:?\s*([^\n]{6,60})", r"(?i)not\s+later\s+than\s+([^\n]{6,60})", r"(?i)submit\w*\s+(?:on\s+or\s+)?before\s+([^\n]{6,60})"), "[0-9]")
DELIVERY = FieldRule("delivery_period", (r"(?i)delivery\s+(?:period|schedule|time)\s*:?\s*([^\n]{1,80})", r"(?i)deliver\w*[^\n.]{0,60}?within\s+([0-9]+\s+(?:calendar|working)?\s*days?[^\n]{0,40})"), "[0-9]")
LOCATION = FieldRule("delivery_location", (r"(?i)(?:place|location)\s+of\s+delivery\s*:?\s*([^\n]{3,120})", r"(?i)deliver(?:ed|y)?\s+to\s*:?\s*([^\n]{3,120})"), "(?i)(street|st\\.|avenue|building|city|barangay|road|hall|office)")
SOLICITATION = FieldRule("solicitation_number", (r"(?i)rfq\s*(?:no\.?|number)\s*:?\s*([A-Z0-9][A-Z0-9 ./-]{2,40})", r"(?i)quotation\s+no\.?\s*:?\s*([A-Z0-9][A-Z0-9./-]{2,40})", r"(?i)solicitation\s+(?:no\.?|number)\s*:?\s*([A-Z0-9][A-Z0-9./-]{2,40})"), "^.{4,}")


def delivery_period(text: Column, structured: Column, source: Column) -> Column:
    """The document's period over the structured one; a bare number is of low confidence and unknown unit."""
    bare = lambda x: x.rlike(r"^[0-9]+$")
    low = lambda x, s: field(x, s, confidence="low", unit=F.lit("unknown"))
    chosen = lambda x, s: bind(x, lambda v: F.when(~bare(v), field(v, s)))
    return bind(
        first_capture(text, DELIVERY),
        lambda doc: F.coalesce(chosen(doc, source), chosen(clean(structured), "notice"), low(doc, source), low(structured, "notice")),
    )


def solicitation_number(text: Column, control: Column, trailing: str = r"(?i)\s+(date|page|company|pr no).*$") -> Column:
    """The solicitation number without a label that follows it; never the control number."""
    found = clean(F.regexp_replace(first_capture(text, SOLICITATION), trailing, ""))
    return F.when((F.length(found) >= 4) & (found != F.coalesce(control, F.lit(""))), found)


CUT_END = r"(?i)(\b(and|or|of|the|for|with|to)|[,(–-])$"


def complete_sentences(parts: Column, shortest: int = 12, cut_end: str = CUT_END, split_at: str = r"\s*[|«]\s*", annex: str = r"(?i)\bannex\b.*$") -> Column:
    """Sentences split at bars, cut at an annex, without fragments.

    A fragment is short, ends with a joining word or an open mark, or opens
    a bracket that it doesn't close.
    """
    pieces = F.flatten(F.transform(parts, lambda s: F.split(s, split_at)))
    pieces = F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, annex, "")))
    opens = lambda s: F.length(s) - F.length(F.translate(s, "(", "")) > F.length(s) - F.length(F.translate(s, ")", ""))
    return F.filter(pieces, lambda s: (F.length(s) >= shortest) & ~s.rlike(cut_end) & ~opens(s))


#: Ordered buckets of requirement sentences, written for this engine; the last one is the default.
BUCKETS = (
    ("security", r"encrypt\w*|password|access\s+control|audit\s+trail"),
    ("training", r"training|orientation|user\s+manual"),
    ("support", r"support|warranty|maintenance|help\s*desk"),
    ("licensing", r"licen[cs]es?|seats?|subscriptions?"),
    ("platform", r"windows|linux|android|browser"),
    ("integration", r"integrat\w*|api|interoperab\w*"),
    ("migration", r"migrat\w*|import\s+of\s+data"),
    ("delivery", r"deliver\w*|install\w*|deploy\w*"),
    ("features", r""),
)


def bucket_of(sentence: Column, buckets: tuple[tuple[str, str], ...] = BUCKETS) -> Column:
    """The first bucket whose words occur, the last one otherwise."""
    hits = [F.when(matches(sentence, p), F.lit(n)) for n, p in buckets[:-1]]
    return F.coalesce(*hits, F.lit(buckets[-1][0]))


def clause_array(parts: Column, buckets: tuple[tuple[str, str], ...] = BUCKETS, gate: str | None = None) -> Column:
    """E14 within a row: the clauses among sentences, ``array<struct(pos, bucket, clause)>``, by lower-cased text.

    Repeats differing in case alone are dropped, and so is a clause with
    which a longer one begins. The longest text that starts with a clause
    sorts right after it, so one look at the next one decides.
    """
    items = F.transform(parts, lambda c, i: F.struct(F.lower(c).alias("low"), i.alias("pos"), c.alias("clause")))
    items = F.filter(items, lambda x: x["clause"].rlike(gate)) if gate else items
    low = lambda xs, i: F.get(xs, i)["low"]
    once = bind(F.sort_array(items), lambda xs: F.filter(xs, lambda x, i: ~x["low"].eqNullSafe(low(xs, i - 1))))
    kept = bind(once, lambda xs: F.filter(xs, lambda x, i: ~F.coalesce(F.startswith(low(xs, i + 1), x["low"]), F.lit(False))))
    return F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), bucket_of(x["clause"], buckets).alias("bucket"), x["clause"].alias("clause")))


def clauses(df: DataFrame, key: str, parts_col: str, buckets: tuple[tuple[str, str], ...] = BUCKETS, gate: str | None = None) -> DataFrame:
    """Requirement clauses ``key, pos, bucket, clause``; all of a document are in its row, so nothing is shuffled."""
    return df.select(key, F.explode(clause_array(F.col(parts_col), buckets, gate)).alias("__c")).select(key, "__c.*")


#: How software is run, by its wordings.
DEPLOYMENTS = (("cloud-based", r"cloud[- ]?based"), ("on-premise", r"on[- ]?premises?"))


def deployment(text: Column, source: Column, wordings: tuple[tuple[str, str], ...] = DEPLOYMENTS) -> Column:
    """How software is run, as a field of medium confidence, if exactly one of the wordings occurs; null otherwise."""
    found = F.array_compact(F.array(*(F.when(matches(text, p), F.lit(n)) for n, p in wordings)))
    return bind(found, lambda f: F.when(F.size(f) == 1, field(F.get(f, F.lit(0)), source, confidence="medium")))


def once_across_buckets(rows: DataFrame, key: str, bucket_order: list[str]) -> DataFrame:
    """Each clause text once in a notice, in the first bucket of a fixed order, then by source and place."""
    rank = F.array_position(F.array(*map(F.lit, bucket_order)), F.col("bucket"))
    order = Window.partitionBy(key, F.lower("clause")).orderBy(rank, "source_order", "pos")
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


@dataclass(frozen=True)
class ItemTemplate:
    """A wording of product lines; groups 1 and 2 are quantity and duration, the rest is constant."""

    name: str
    pattern: str
    unit: str
    license_type: str | None = None


TEMPLATES = (
    ItemTemplate("licenses", r"(?i)([0-9]+)\s+(?:user\s+)?licenses?[^\n]{0,40}?(?:for\s+([0-9]+\s+(?:year|month)s?))?", "license", "per user"),
    ItemTemplate("subscription", r"(?i)([0-9]+)\s+(?:annual\s+)?subscriptions?(?:\s+for\s+([0-9]+\s+(?:year|month)s?))?", "subscription", "subscription"),
)


def template_items(df: DataFrame, key: str, text_col: str, templates: tuple[ItemTemplate, ...] = TEMPLATES) -> DataFrame:
    """``key, template, pos, quantity, unit, duration, license_type, quote`` of every match of every template."""
    rows = []
    for t in templates:
        quotes = df.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(t.pattern), F.lit(0))).alias("pos", "quote"))
        part = lambda i, t=t: F.regexp_extract("quote", t.pattern, i)
        rows.append(
            quotes.select(
                key, F.lit(t.name).alias("template"), "pos", part(1).try_cast("int").alias("quantity"), F.lit(t.unit).alias("unit"),
                clean(part(2)).alias("duration"), F.lit(t.license_type).alias("license_type"), "quote",
            )
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def structured_items(lots: DataFrame, key: str, name: str, quantity: str, unit: str, useless: str = r"(?i)^(lot|item)?\s*[0-9]*$") -> DataFrame:
    """Lots with a useful name as items; a license unit makes the quantity the number of licenses."""
    kept = lots.filter(F.coalesce(F.trim(F.col(name)), F.lit("")) != "").filter(~F.col(name).rlike(useless))
    return kept.select(key, F.trim(F.col(name)).alias("description"), F.col(quantity).alias("quantity"), F.col(unit).alias("unit"), F.when(F.lower(unit).contains("licen"), F.col(quantity)).alias("licenses"))


def merged_items(text_items: DataFrame, structured: DataFrame, key: str) -> DataFrame:
    """Text items replace the structured ones of a notice when it has any."""
    return text_items.unionByName(structured.join(text_items.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def reconciled(candidates: DataFrame, key: str, value: str, rank: str, source: str) -> DataFrame:
    """Per key the value of the best-ranked source, its scope, and what disagrees.

    ``scope`` is single, corroborated (all sources agree) or conflicting; the
    other values are listed as ``struct(source, value)``.
    """
    c = candidates.filter(F.col(value).isNotNull())
    best = c.groupBy(key).agg(
        F.min_by(value, F.col(rank)).alias("value"), F.min_by(source, F.col(rank)).alias("from_source"), F.count("*").alias("n"), F.count_distinct(value).alias("kinds"),
        F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(source).alias("source"), F.col(value).alias("value")))).alias("all"),
    )
    others = F.transform(F.filter("all", lambda x: x["value"] != F.col("value")), lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value")))
    scope = F.when(F.col("n") == 1, "single").when(F.col("kinds") == 1, "corroborated").otherwise("conflicting")
    return best.select(key, "value", "from_source", scope.alias("scope"), others.alias("conflicts"), (F.col("kinds") > 1).alias("needs_review"))


TAX = r"(?i)(vat|tax)\s+(inclusive|exclusive|exempt)"


def wording_around(text: Column, pattern: str, around: int = 80) -> Column:
    """A wording with so many characters on either side."""
    flat = F.regexp_replace(text, r"\s+", " ")
    hit = F.regexp_extract(flat, pattern, 0)
    at = F.position(hit, flat)
    begin = F.greatest(at - around, F.lit(1))
    return F.when(hit != "", F.trim(F.substring(flat, begin, at + F.length(hit) + around - begin)))


def submission_method(text: Column) -> Column:
    """How to submit: an email phrase first, else a keyword."""
    by_mail = capture(text, r"(?i)((?:submit|send)[^\n.]{0,60}(?:e-?mail|@)[^\n.]{0,40})")
    word = F.lower(capture(text, r"(?i)\b(sealed envelope|courier|hand carr(?:y|ied)|online portal)\b"))
    return F.coalesce(by_mail, word)


def document_requirements(df: DataFrame, key: str, text_col: str, source_col: str, notice: dict[str, str], rules: tuple[FieldRule, ...]) -> DataFrame:
    """Per document a provenance field for each rule: the document's value over the notice's column of that name."""
    columns = []
    for r in rules:
        doc = field(first_capture(F.col(text_col), r), F.col(source_col))
        columns.append((F.coalesce(doc, field(F.col(notice[r.name]), "notice")) if r.name in notice else doc).alias(r.name))
    return df.select(key, *columns)


#: Single fields of a requirements record, for notices in English; the notice's own column stands in where it has one.
RECORD = (
    FieldRule("product", (r"(?i)intends\s+to\s+(?:buy|procure)\s+[\"“]([^\"”\n]+)",)),
    FieldRule("control_number", (r"(?i)control\s+no\.?\s*:?\s*([A-Z0-9-]+)",)),
    DEADLINE,
    FieldRule("budget", (r"(?i)(?:approved\s+budget|abc)[^\n]{0,80}?(?:php|₱)\s*([0-9,]+(?:\.[0-9]{2})?)",), "[0-9]"),
    FieldRule("place", (r"(?i)place\s+of\s+delivery\s*:\s*([^\n]+)",)),
    DELIVERY,
    FieldRule("awarding", (r"(?i)awarding\s*:\s*([^\n]+)",)),
    FieldRule("payment_terms", (r"(?i)payment\s+terms?\s*:\s*([^.]+\.)",)),
    FieldRule("contact", (r"(?i)contact\s+person\s*:?\s*([^\n,;]{3,60})", r"(?i)attention\s*:\s*([^\n,;]{3,60})"), "[A-Za-z]{2}"),
)
REQUIRED_LINE = r"(?m)^[0-9]+[.)]\s+([^\n]+)$"
REQUIRED_WORDS = r"(?i)permit|registration|omnibus|income\s+tax|certificate"
#: Named sentences that a record quotes.
QUOTED = (
    ("warranty", r"warrant(y|ies)"), ("penalty", r"liquidated\s+damages|penalt(y|ies)"), ("validity", r"price\s+validity|validity\s+of"), ("partial", r"partial\s+(bids?|deliver(y|ies))"),
    ("alternative", r"alternative\s+(bids?|offers?)"), ("tax", r"(vat|tax)\s+(inclusive|exclusive|exempt)"), ("training", r"training"), ("support", r"technical\s+support"), ("acceptance", r"inspection\s+and\s+acceptance"),
)


def required_documents(text: Column, bidder: str = BIDDER) -> Column:
    """Numbered lines that name a document to hand in, without fields for bidders."""
    lines = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REQUIRED_LINE), F.lit(1)), lambda s: clean(s))
    return F.filter(lines, lambda s: s.rlike(REQUIRED_WORDS) & ~s.rlike(bidder))


def quoted_clauses(parts: Column, quoted: tuple[tuple[str, str], ...] = QUOTED) -> Column:
    """For each named pattern the first sentence that holds it, ``array<struct(name, quote)>``."""
    first = lambda p: F.get(F.filter(parts, lambda s: matches(s, p)), F.lit(0))
    found = F.array(*(F.struct(F.lit(n).alias("name"), first(p).alias("quote")) for n, p in quoted))
    return F.filter(found, lambda x: x["quote"].isNotNull())


def requirements_record(
    df: DataFrame, key: str, text_col: str, source_col: str, parts: Column, notice: dict[str, str], rules: tuple[FieldRule, ...] = RECORD,
    buckets: tuple[tuple[str, str], ...] = BUCKETS, gate: str | None = None, quoted: tuple[tuple[str, str], ...] = QUOTED,
) -> DataFrame:
    """The whole record of each document: fields, required documents, quotes, clauses by bucket, method, missing fields.

    ``parts`` are the sentences of the text. A field that neither the document
    nor the notice gives is null and is named in ``missing_fields``; none is
    invented. Empty or null texts give records of the notice alone.
    """
    names = [r.name for r in rules]
    rows = df.withColumns({"__parts": parts, "__required": required_documents(F.col(text_col)), "__method": submission_method(F.col(text_col))})
    columns = {}
    for r in rules:
        doc = field(first_capture(F.col(text_col), r), F.col(source_col))
        columns[r.name] = F.coalesce(doc, field(F.col(notice[r.name]), "notice")) if r.name in notice else doc
    out = rows.withColumns(columns)
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in names)))
    return out.select(
        key, *names, F.col("__required").alias("required_documents"), F.col("__method").alias("submission_method"),
        quoted_clauses(F.col("__parts"), quoted).alias("quotes"), clause_array(F.col("__parts"), buckets, gate).alias("clauses"), missing.alias("missing_fields"),
    )


def bulk_requirements(docs: DataFrame, chosen: DataFrame, key: str, **record) -> DataFrame:
    """The records of the documents of chosen notices; pass the rest of ``requirements_record``'s arguments by name."""
    return requirements_record(docs.join(chosen.select(key).distinct(), key, "left_semi"), key, **record)


def full_records(records: DataFrame, items: DataFrame, notices: DataFrame, key: str, budget: str, listed: str, core: dict[str, str]) -> DataFrame:
    """The whole record of each notice: ``key, record, items, budget, status, missing_fields, review_fields``.

    ``records`` are those of ``requirements_record`` (``budget`` names their
    field of it), ``items`` those of E15, E16 or ``merged_items``, ``listed``
    is the notice's own budget. The budgets are reconciled (E17), the
    document's first. Missing are the budget, items, and the ``core`` fields
    (name in the result to field of the record) that nothing gives. A record
    whose budgets disagree needs review; one with something missing, or with
    an item that has neither quantity nor licenses, is partial (E19).
    """
    names = [c for c in items.columns if c != key]
    listed_items = items.groupBy(F.col(key).alias("__i")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("items"))
    rows = records.join(listed_items, F.col(key) == F.col("__i"), "left").join(notices.select(F.col(key).alias("__n"), F.col(listed).cast("decimal(18,2)").alias("__listed")), F.col(key) == F.col("__n"), "left")
    found = F.col(budget)
    candidates = rows.select(key, F.explode(F.array(
        F.struct(F.lit(0).alias("rank"), found["source"].alias("source"), money(found["value"]).alias("value")),
        F.struct(F.lit(1).alias("rank"), F.lit("notice").alias("source"), F.col("__listed").alias("value")),
    )).alias("c")).select(key, "c.*")
    agreed = reconciled(candidates, key, "value", "rank", "source").select(F.col(key).alias("__b"), F.struct("value", "from_source", "scope", "conflicts").alias("__budget"), F.col("needs_review").alias("__differs"))
    rows = rows.join(agreed, F.col(key) == F.col("__b"), "left").withColumn("items", F.coalesce("items", F.array().cast(listed_items.schema["items"].dataType)))
    differs = F.coalesce("__differs", F.lit(False))
    needed = {"budget": F.col("__budget"), "items": F.when(F.size("items") > 0, F.lit(True)), **{n: F.col(c) for n, c in core.items()}}
    gaps = {"an item": F.when(~F.exists("items", lambda x: x["quantity"].isNull() & x["licenses"].isNull()), F.lit(True))}
    missing, status = completeness(needed, gaps, differs)
    record = F.struct(*(c for c in records.columns if c not in (key, "missing_fields")))
    review = F.when(differs, F.array(F.lit("budget"))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, record.alias("record"), "items", F.col("__budget").alias("budget"), status.alias("status"), missing.alias("missing_fields"), review.alias("review_fields"))


def identity_fields(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Columns of a notice as provenance fields of the notice; blank ones are null."""
    return df.select(key, *(field(clean(F.col(c).cast("string")), "notice").alias(n) for n, c in names.items()))


def technical_summary(items: DataFrame, clause_rows: DataFrame, key: str, bucket_order: list[str]) -> DataFrame:
    """Per notice its facts, clauses in bucket order and source labels.

    Facts name license type and duration of items, numbered if there are
    several. Sources are numbered in the order in which clauses name them.
    """
    n = F.count("*").over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    suffix = F.when(n > 1, F.concat(F.lit(" (item "), place.cast("string"), F.lit(")"))).otherwise("")
    fact = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(name), suffix, F.lit(": "), F.col(c)))
    facts = items.select(key, "pos", F.array_compact(F.array(fact("License type", "license_type"), fact("Duration", "duration"))).alias("f"))
    facts = facts.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"])).alias("facts"))
    rank = F.array_position(F.array(*map(F.lit, bucket_order)), F.col("bucket"))
    listed = clause_rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), F.col("source_order"), F.col("pos"), F.col("bucket"), F.col("clause"), F.col("source")))).alias("c"))
    sources = F.array_distinct(F.transform("c", lambda x: x["source"]))
    labels = F.transform(sources, lambda s, i: F.concat(F.lit("Document "), F.lpad((i + 1).cast("string"), 2, "0"), F.lit(": "), s))
    out = listed.select(key, F.transform("c", lambda x: F.struct(x["bucket"], x["clause"])).alias("clauses"), labels.alias("documents"))
    return out.join(facts, key, "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))


#: Fixed values. Names that aren't documents of a notice; the second stands for the notice itself.
NO_DOCUMENTS = ("metadata.json", "notice")
_RECORD = "struct<value:string,source:string>"


def summary_facts(items: DataFrame, notices: DataFrame, key: str, pos: str, license_type: str, duration: str, delivery: str, deployment: str) -> DataFrame:
    """The facts of each notice, a row each: ``key, place, label, value, source``.

    License type and duration of each item, numbered if there are several
    items; the duration of the delivery only if no item has one; then the
    deployment. All are structs ``value, source``; those without a value are no facts.
    """
    record = lambda c: F.when(F.coalesce(F.trim(F.col(c)["value"]), F.lit("")) != "", F.struct(F.trim(F.col(c)["value"]).alias("value"), F.col(c)["source"].alias("source"))).cast(_RECORD)
    of_key = Window.partitionBy(key)
    nth = F.row_number().over(of_key.orderBy(pos))
    suffix = F.when(F.count("*").over(of_key) > 1, F.concat(F.lit(" "), nth.cast("string"))).otherwise("")
    rows = items.select(key, nth.alias("__n"), suffix.alias("__suffix"), record(license_type).alias("__type"), record(duration).alias("__duration"))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit("License type").alias("label"), F.col("__type").alias("r")), F.struct(F.lit(1).alias("i"), F.lit("Duration").alias("label"), F.col("__duration").alias("r")))
    of_items = rows.select(key, (F.col("__n") * 2).alias("__at"), "__suffix", F.explode(both).alias("f")).filter("f.r IS NOT NULL")
    of_items = of_items.select(key, (F.col("__at") + F.col("f.i")).alias("at"), F.concat("f.label", "__suffix").alias("label"), "f.r.*")
    timed = rows.filter("__duration IS NOT NULL").select(F.col(key).alias("__k")).distinct()
    rest = notices.join(timed, F.col(key) == F.col("__k"), "left")
    late = F.lit((1 << 31) - 3)
    own = F.array(
        F.struct(late.alias("at"), F.lit("Duration").alias("label"), F.when(F.col("__k").isNull(), record(delivery)).alias("r")),
        F.struct((late + 1).alias("at"), F.lit("Deployment").alias("label"), record(deployment).alias("r")),
    )
    of_notice = rest.select(key, F.explode(own).alias("f")).filter("f.r IS NOT NULL").select(key, "f.at", "f.label", "f.r.*")
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return of_items.unionByName(of_notice).withColumn("place", place).select(key, "place", "label", "value", "source")


def source_documents(named: DataFrame, key: str, tier: str, pos: str, name: str) -> DataFrame:
    """The documents of a notice in the order in which they are named first: ``key, number, name``.

    ``tier`` ranks where a name comes from: listed sources, clauses, facts,
    files of the packet. Blank names and ``NO_DOCUMENTS`` don't count.
    """
    text = F.trim(F.col(name))
    kept = named.select(key, text.alias("name"), F.struct(tier, pos).alias("__at")).filter(F.coalesce("name", F.lit("")) != "").filter(~F.col("name").isin(*NO_DOCUMENTS))
    first = kept.groupBy(key, "name").agg(F.min("__at").alias("__at"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("__at", "name")).alias("number"), "name")


def cited(facts: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Facts with ``source_label``: the number of the document that they cite, the notice, or a document that isn't listed; null without a source."""
    numbers = documents.select(F.col(key).alias("__k"), F.col("name").alias("__name"), "number")
    rows = facts.join(numbers, (F.col(key) == F.col("__k")) & (F.trim("source") == F.col("__name")), "left")
    label = F.when(F.coalesce(F.trim("source"), F.lit("")) == "", None).when(F.trim("source") == NO_DOCUMENTS[1], "Notice")
    numbered = F.concat(F.lit("Document "), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(2), F.length(F.col("number").cast("string"))), F.lit("0")))
    return rows.withColumn("source_label", label.when(F.col("number").isNotNull(), numbered).otherwise("Source document")).drop("__k", "__name", "number")


def name_forms(name: Column) -> tuple[Column, Column]:
    """A file name in lower case with single spaces for ``_``, ``-`` and white space; and that without its extension."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"[\s_-]+", " "))
    return plain, F.regexp_replace(plain, r"\.[a-z0-9]{1,8}$", "")


def document_links(documents: DataFrame, files: DataFrame, states: DataFrame, key: str, name: str = "name", filename: str = "filename", url: str = "url", state: str = "state") -> DataFrame:
    """What each document name of a notice leads to: ``key, name, href, status, tier``.

    A name is looked for among the notice's files as it is, then in its plain
    form, then without extension (``exact``, ``plain``, ``stem``); each tier
    sees the names that the one before left over. A tier that finds one URL
    is ``available``, several are ``ambiguous`` and end the search, none at
    all is ``unavailable``. While the files aren't ``ready`` a name is
    ``unknown`` after an error and ``checking`` otherwise, also without a state.
    """
    nothing = F.lit(None).cast("string")
    now = states.select(F.col(key).alias("__s"), F.col(state).alias("__state"))
    names = documents.select(key, F.col(name).alias("name")).repartition(key).distinct().join(now, F.col(key) == F.col("__s"), "left").drop("__s")
    ready = F.coalesce(F.col("__state"), F.lit("")) == "ready"
    waiting = F.when(F.col("__state").isin("error", "unavailable"), "unknown").otherwise("checking")
    out = names.filter(~ready).select(key, "name", nothing.alias("href"), waiting.alias("status"), nothing.alias("tier"))
    # names that are equal are equal in plain form, and those are equal without extension: names and files meet once, by the last
    listed = files.filter(F.col(url).isNotNull() & F.col(filename).isNotNull()).select(key, F.col(filename).alias("name"), F.col(url).cast("string").alias("__url"))
    both = names.filter(ready).select(key, "name", nothing.alias("__url"), F.lit(True).alias("__asked")).union(listed.select("*", F.lit(False)))
    plain, stem = name_forms(F.col("name"))
    both = both.withColumns({"__plain": plain, "__stem": stem})
    tiers = {"exact": Window.partitionBy(key, "__stem", "__plain", "name"), "plain": Window.partitionBy(key, "__stem", "__plain"), "stem": Window.partitionBy(key, "__stem")}
    for tier, w in reversed(tiers.items()):
        both = both.withColumns({f"__{tier}_least": F.min("__url").over(w), f"__{tier}_most": F.max("__url").over(w)})
    met = F.coalesce(*(F.when(F.col(f"__{t}_least").isNotNull(), F.struct(F.col(f"__{t}_least").alias("least"), F.col(f"__{t}_most").alias("most"), F.lit(t).alias("tier"))) for t in tiers))
    found = both.filter("__asked").withColumn("__met", met)
    one = F.col("__met.least") == F.col("__met.most")
    status = F.when(one, "available").when(F.col("__met").isNull(), "unavailable").otherwise("ambiguous")
    return out.unionByName(found.select(key, "name", F.when(one, F.col("__met.least")).alias("href"), status.alias("status"), F.col("__met.tier").alias("tier")))
