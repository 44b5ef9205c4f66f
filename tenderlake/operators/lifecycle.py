"""Keyed state: decisions, reviews, reads, markings, merges and history.

Commands are rows; a fold over them gives the state, whatever the order in
which they are stored, since each has a time and a sequence number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import known_date, slash_date
from ..functions.money import money


def normal_decision(text: Column) -> Column:
    """M1: product, not relevant or review from common spellings, else null."""
    t = F.regexp_replace(F.lower(F.trim(text)), "[_-]+", " ")
    return F.when(t.isin("product", "software", "relevant", "yes"), "product").when(t.isin("not relevant", "irrelevant", "no", "skip"), "not relevant").when(t.isin("review", "unsure"), "review")


def decisions(commands: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """M1: the last valid decision of each key, with its time order columns."""
    valid = commands.withColumn("decision", normal_decision(F.col(value))).filter("decision IS NOT NULL")
    place = F.struct(*order)
    return valid.groupBy(key).agg(F.max_by("decision", place).alias("decision"), F.max(order[0]).alias("decided_at"), F.count("*").alias("n_decisions"))


#: What a decision by a person says; such a reason replaces an earlier one.
DECIDED = {"product": "a person marked this as a product", "not relevant": "a person marked this as not relevant", "review": "a person kept this for review"}


def applied_decisions(packets: DataFrame, decided: DataFrame, key: str, label: str = "label", category: str = "category", reasons: str = "reasons", status: str = "work_status", at: str = "reviewed_at") -> DataFrame:
    """M1: packets with the decisions of ``decisions`` applied; the others as they were.

    A decision sets the label and both flags (``is_relevant``,
    ``needs_review``), the category (a product's or other goods'; kept for
    review, those two are unknown), the manual source and the time of review,
    and replaces the reason of an earlier decision. A product without a work
    status is new; other packets keep theirs.
    """
    side = decided.select(F.col(key).alias("__k"), F.col("decision").alias("__d"), F.col("decided_at").alias("__at"))
    rows = packets.join(side, F.col(key) == F.col("__k"), "left")
    d, made = F.col("__d"), F.col("__d").isNotNull()
    said = F.element_at(F.create_map(*(F.lit(x) for pair in DECIDED.items() for x in pair)), d)
    kept = F.filter(F.coalesce(F.col(reasons), F.array().cast("array<string>")), lambda x: ~x.isin(*DECIDED.values()))
    of_kind = F.when(d == "product", "product").when(d == "not relevant", "goods").when(F.col(category).isin("product", "goods"), "unknown").otherwise(F.col(category))
    label_now = F.coalesce(d, F.col(label))
    new = {
        label: label_now, "is_relevant": F.when(made, d == "product").otherwise(F.col("is_relevant")), "needs_review": F.when(made, d == "review").otherwise(F.col("needs_review")),
        category: F.when(made, of_kind).otherwise(F.col(category)), reasons: F.when(made, F.concat(kept, F.array(said))).otherwise(F.col(reasons)), "source": F.when(made, "manual").otherwise(F.col("source")),
        at: F.when(made, F.col("__at")).otherwise(F.col(at)), status: F.when(made, work_status(F.col(status), label_now)).otherwise(F.col(status)),
    }
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in packets.columns))


def manual_over_automatic(automatic: DataFrame, manual: DataFrame, key: str, column: str) -> DataFrame:
    """M2: a manual value stays, whatever is found later; ``source`` says which it is."""
    side = manual.select(F.col(key).alias("__k"), F.col(column).alias("__m")).filter("__m IS NOT NULL")
    return (
        automatic.join(side, F.col(key) == F.col("__k"), "left")
        .withColumn("source", F.when(F.col("__m").isNotNull(), "manual").otherwise("automatic"))
        .withColumn(column, F.coalesce("__m", column))
        .drop("__k", "__m")
    )


def work_status(status: Column, label: Column) -> Column:
    """M3: new, in-progress or done from common spellings; products start as new, other labels keep what is stored."""
    t = F.regexp_replace(F.lower(F.trim(status)), "[ _]+", "-")
    known = F.when(t.isin("new", "open"), "new").when(t.isin("in-progress", "inprogress", "started"), "in-progress").when(t.isin("done", "finished", "completed"), "done")
    return F.coalesce(known, F.when(label == "product", "new"))


def first_review(events: DataFrame, key: str, at: str, is_review: Column) -> DataFrame:
    """M4: the first review time of each key; keys without one are pending."""
    return events.groupBy(key).agg(F.min(F.when(is_review, F.col(at))).alias("reviewed_at")).withColumn("pending", F.col("reviewed_at").isNull())


def repaired_reads(notices: DataFrame, reads: DataFrame, key: str, appeared: str, read_at: str, cutoff: str) -> DataFrame:
    """M5: read times after a repair from ``cutoff``.

    The first read of a key counts. Notices that appeared by the cutoff keep a
    read or get the cutoff; later ones keep only reads after it. Reads of
    unknown keys drop out.
    """
    first = reads.groupBy(F.col(key).alias("__k")).agg(F.min(read_at).alias("__r"))
    cut = F.lit(cutoff).cast(notices.schema[appeared].dataType)
    kept = F.when(F.col(appeared) <= cut, F.coalesce("__r", cut)).when(F.col("__r") > cut, F.col("__r"))
    return notices.join(first, F.col(key) == F.col("__k"), "left").select(key, kept.alias("read_at")).filter("read_at IS NOT NULL")


def markings(commands: DataFrame, key: str, op: str, value: str, at: str, seq: str) -> DataFrame:
    """M6: markings that stand: the last command isn't a delete; the first mark since the last delete dates it."""
    w = Window.partitionBy(key)
    deleted = F.max(F.when(F.col(op) == "unmark", F.struct(at, seq))).over(w)
    since = commands.withColumn("__d", deleted).filter((F.col(op) == "mark") & (F.col("__d").isNull() | (F.struct(at, seq) > F.col("__d"))))
    return since.groupBy(key).agg(F.min(at).alias("marked_at"), F.max(at).alias("updated_at"), F.max_by(value, F.struct(at, seq)).alias("status"))


def merged_checks(previous: DataFrame, checks: DataFrame, key: str, ok: str, awards: str, conflicts: str) -> DataFrame:
    """M7: what a check leaves: ``key, outcome, awards``.

    A failed check, and one with conflicts and no awards, keeps the previous
    awards. Outcomes are failed, conflict, published and none.
    """
    before = previous.select(F.col(key).alias("__k"), F.col(awards).alias("__a"))
    rows = checks.join(before, F.col(key) == F.col("__k"), "left")
    none = F.coalesce(F.col(awards), F.lit(0)) == 0
    outcome = F.when(~F.col(ok), "failed").when(F.col(conflicts) > 0, "conflict").when(none, "none").otherwise("published")
    keep = (outcome == "failed") | ((outcome == "conflict") & none)
    return rows.select(key, outcome.alias("outcome"), F.when(keep, F.coalesce("__a", F.lit(0))).otherwise(F.coalesce(awards, F.lit(0))).alias(awards))


def meaning(value: Column, kind: Column) -> Column:
    """M8: what a text says, by which values are compared: an amount's number, a date's day, any other text trimmed."""
    day = F.coalesce(known_date(value), slash_date(value).cast("date"), F.to_date(F.try_to_timestamp(F.trim(value), F.lit("d MMMM yyyy"))))
    said = F.when(kind == "amount", money(value).cast("string")).when(kind == "date", day.cast("string"))
    return F.coalesce(said, F.trim(value))


def screened_import(incoming: DataFrame, key: str, kinds: dict[str, str], required: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """M8: the rows of an import that can be read, and the others as ``key, error``.

    A row is rejected for the first of: no key, a required field without
    text, an amount or date (``kinds``) that isn't one. Blank fields are null.
    """
    clean = incoming.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in incoming.dtypes))
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in [key, *required]]
    checks += [F.when(F.col(c).isNotNull() & money(F.col(c)).isNull(), F.lit(f"unrecognized amount: {c}")) for c, k in kinds.items() if k == "amount"]
    checks += [F.when(F.col(c).isNotNull() & ~meaning(F.col(c), F.lit("date")).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(f"unrecognized date: {c}")) for c, k in kinds.items() if k == "date"]
    judged = clean.withColumn("__error", F.coalesce(*checks))
    return judged.filter("__error IS NULL").drop("__error"), judged.filter("__error IS NOT NULL").select(key, F.col("__error").alias("error"))


def import_duplicates(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """M8: ``key, order`` of each incoming row whose key is stored already or came before it in the import."""
    known = stored.select(F.col(key).alias("__k")).distinct()
    first = incoming.groupBy(F.col(key).alias("__i")).agg(F.min(order).alias("__first"))
    rows = incoming.select(key, order).join(first, F.col(key) == F.col("__i")).join(known, F.col(key) == F.col("__k"), "left")
    return rows.filter(F.col("__k").isNotNull() | (F.col(order) > F.col("__first"))).select(key, order)


def import_merge(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str], order: str, lifecycle: dict[str, list[tuple[str, str]] | None], kinds: dict[str, str] = {}) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """M8: merged records, and the changes and conflicts ``key, field, stored, incoming, action`` of each field.

    Incoming rows of a key are folded in order: a null field is filled; a
    field in ``lifecycle`` takes an allowed change (None: any); another
    value is a conflict and the stored one stays. Null values do nothing, nor
    do those of the same ``meaning``, by the ``kinds`` of the fields.
    """
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("field")), F.lit("text")) if kinds else F.lit("text")
    text = lambda df: df.select(key, *(F.col(f).cast("string").alias(f) for f in fields), *([order] if order in df.columns else []))
    long = lambda df, *more: df.unpivot([key, *more], fields, "field", "value")
    old = long(text(stored)).withColumnsRenamed({key: "__k", "field": "__f", "value": "stored"})
    new = long(text(incoming), order).filter("value IS NOT NULL").withColumn("says", meaning(F.col("value"), kind))
    new = new.groupBy(key, "field").agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col("value"), F.col("says")))).alias("steps"))

    def allowed(f: Column, now: Column, then: Column) -> Column:
        out = F.lit(False)
        for name, moves in lifecycle.items():
            ok = F.lit(True) if moves is None else F.concat_ws(">", now, then).isin(*(f"{a}>{b}" for a, b in moves))
            out = out | ((f == name) & ok)
        return out

    def fold(acc: Column, step: Column) -> Column:
        now, then = acc["now"], step["value"]
        action = F.when(now.isNull(), "filled").when(acc["says"] == step["says"], "same").when(allowed(F.col("field"), now, then), "changed").otherwise("conflict")
        entry = F.struct(now.alias("stored"), then.alias("incoming"), action.alias("action"))
        taken = action.isin("filled", "changed")
        return F.struct(F.when(taken, then).otherwise(now).alias("now"), F.when(taken, step["says"]).otherwise(acc["says"]).alias("says"), F.concat(acc["log"], F.array(entry)).alias("log"))

    joined = new.join(old, (F.col(key) == F.col("__k")) & (F.col("field") == F.col("__f")), "full_outer")
    joined = joined.select(F.coalesce(key, "__k").alias(key), F.coalesce("field", "__f").alias("field"), "stored", "steps")
    start = F.struct(F.col("stored").alias("now"), meaning(F.col("stored"), kind).alias("says"), F.array().cast("array<struct<stored:string,incoming:string,action:string>>").alias("log"))
    steps = F.coalesce("steps", F.array().cast(joined.schema["steps"].dataType))
    done = joined.withColumn("r", F.aggregate(steps, start, fold))
    merged = done.groupBy(key).pivot("field", fields).agg(F.first("r.now"))
    log = done.select(key, "field", F.explode("r.log").alias("e")).select(key, "field", "e.stored", "e.incoming", "e.action").filter("action != 'same'")
    return merged, log


def history(versions: DataFrame, key: str, order: str, content: list[str]) -> DataFrame:
    """M9: versions whose content differs from the one before, with ``version`` and the end ``until`` of each.

    Columns that aren't content, such as a verification time, make no version.
    """
    w = Window.partitionBy(key).orderBy(order)
    mark = F.xxhash64(*content)
    changed = versions.withColumn("__h", mark).withColumn("__b", F.lag("__h").over(w)).filter(F.col("__b").isNull() | (F.col("__h") != F.col("__b")))
    return changed.withColumn("version", F.row_number().over(w)).withColumn("until", F.lead(order).over(w)).drop("__h", "__b")


def party_standing(bids: DataFrame, key: str, name: Column, aliases: DataFrame, alias: str, outcome: Column | None = None) -> DataFrame:
    """Per bid: own, other, mixed or unverified, from its parties; ``aliases`` are our names, normalised (a small table).

    ``outcome`` is that of the bid's check, the same in all of its rows:
    failed, conflict and none stand for themselves, anything but published is
    never. A blank party is no other party, so it doesn't make an own award
    mixed; others beside a blank one are unverified.
    """
    rows = bids.withColumn("__n", name).join(aliases.select(F.col(alias).alias("__a")).distinct(), F.col("__n") == F.col("__a"), "left")
    own, blank = F.col("__a").isNotNull(), F.coalesce("__n", F.lit("")) == ""
    ours, named = F.bool_or(own), F.bool_or(~own & ~blank)
    standing = F.when(ours & named, "mixed").when(ours, "own").when(named & ~F.bool_or(blank), "other").otherwise("unverified")
    if outcome is not None:
        found = F.max(outcome)
        standing = F.when(found.isin("failed", "conflict", "none"), found).when(F.coalesce(found, F.lit("")) != "published", "never").otherwise(standing)
    return rows.groupBy(key).agg(standing.alias("standing"), F.count("*").alias("n_parties"))


def reclassification_plan(stored_source: Column, stored_label: Column, new_label: Column) -> Column:
    """Skip-manual, keep, refresh or update of a dry run over titles; a new label of review decides nothing."""
    return (
        F.when(stored_source == "manual", "skip-manual")
        .when(new_label == "review", "keep")
        .when(stored_label == new_label, "refresh")
        .otherwise("update")
    )


def completeness(core: dict[str, Column], material: dict[str, Column], flags: Column) -> tuple[Column, Column]:
    """Missing core fields, and needs_review, partial or complete."""
    missing = F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in core.items())))
    gaps = F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in material.items())))
    status = F.when(flags, "needs_review").when((F.size(missing) > 0) | (F.size(gaps) > 0), "partial").otherwise("complete")
    return missing, status


def upsert(current: DataFrame, incoming: DataFrame, key: str, survive: list[str]) -> DataFrame:
    """Incoming rows replace current ones by key; columns in ``survive`` keep a current value that isn't null."""
    columns = [c for c in current.columns if c != key]
    new = incoming.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__n_{c}") if c in incoming.columns else F.lit(None).alias(f"__n_{c}") for c in columns))
    both = current.join(new, F.col(key) == F.col("__k"), "full_outer")
    arrived = F.col("__k").isNotNull()
    pick = lambda c: F.coalesce(c, f"__n_{c}") if c in survive else F.when(arrived, F.col(f"__n_{c}")).otherwise(F.col(c))
    return both.select(F.coalesce(key, "__k").alias(key), *(pick(c).alias(c) for c in columns))


def keep_first_append(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``incoming`` with ``outcome``: saved for the first new row of a key, exists for all others."""
    known = target.select(F.col(key).alias("__k")).distinct()
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = incoming.withColumn("__rn", rn).join(known, F.col(key) == F.col("__k"), "left")
    return rows.withColumn("outcome", F.when(F.col("__k").isNull() & (F.col("__rn") == 1), "saved").otherwise("exists")).drop("__k", "__rn")
