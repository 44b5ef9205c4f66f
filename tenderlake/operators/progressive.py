"""Evidence that grows page by page, folded in page order until it decides.

What a decision rests on (terms, family ranks, contexts) is a struct that is
merged by unions, so a page's text is matched when it arrives and not again.
Only the text after the last safe line end is carried to the next page: no
rule may match across one of ``BREAKS`` before the end of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CONTEXT, RuleSet, context_flags, has, matches, stripped, terms_found
from ..functions.text import bind
from .classify import classify, decision_by, focus_patterns, label, sentences, vetoed

#: Fixed value. Characters that no rule pattern matches.
BREAKS = "[.!?;]"
FAMILIES = ("excluded", "services", "physical", "categories")


def page_evidence(text: Column, rules: RuleSet) -> Column:
    """What a stripped text shows: terms, the rank of the first label of each family, contexts."""

    def of(source: Column) -> Column:
        def rank(family: tuple[tuple[str, str], ...]) -> Column:
            return F.coalesce(*(F.when(matches(source, p), F.lit(i)) for i, (_, p) in enumerate(family)), F.lit(None).cast("int"))

        return F.struct(
            terms_found(source, rules.product_terms).alias("products"), terms_found(source, rules.goods_terms).alias("goods"),
            *(rank(getattr(rules, name)).alias(name) for name in FAMILIES), *(has(source, rules, name).alias(name) for name in CONTEXT),
        )

    return bind(stripped(text, rules.incidental), of)


def merged(a: Column, b: Column) -> Column:
    """The evidence of two texts one after the other. It is associative, and empty evidence changes nothing."""
    union = lambda name: F.array_union(a[name], b[name]).alias(name)
    return F.struct(
        union("products"), union("goods"), *(F.least(a[name], b[name]).alias(name) for name in FAMILIES), *((a[name] | b[name]).alias(name) for name in CONTEXT)
    )


def decided(evidence: Column, rules: RuleSet) -> Column:
    """T6 over merged evidence."""
    flags = context_flags(rules, evidence["products"], evidence["goods"], lambda name: evidence[name])
    named = {"excluded": "excluded", "service": "services", "physical": "physical", "category_label": "categories", "products": "products"}
    return decision_by(lambda name: flags[name.removeprefix("is_")] if name.startswith("is_") else evidence[named[name]])


def _closed_and_open(text: Column) -> Column:
    """A text up to its last safe line end, and the rest."""
    head = F.when(text.rlike(rf"{BREAKS}\s*$"), text).otherwise(F.regexp_extract(text, rf"(?s)^(.*{BREAKS}[ \t\r]*\n)", 1))
    return bind(head, lambda h: F.struct(h.alias("closed"), text.substr(F.length(h) + 1, F.length(text)).alias("open")))


def _joined(a: Column, b: Column) -> Column:
    return F.concat_ws("\n", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def progressive_decision(
    pages: DataFrame, key: str, page_col: str, text_col: str, rules: RuleSet, title_col: str | None = None, most: int = 6, least_chars: int = 40,
    marker: str | None = None, budget: int = 4_000, newline_only: bool = False,
) -> DataFrame:
    """Per ``key`` the page at which the text read so far decides: ``key, page, label, n_read``.

    The first ``most`` pages are read in order, joined by lines. What is
    before a form ``marker``, up to ``budget`` characters, is judged as a
    document of one section: incidental phrases go, item sentences are
    focused on, and a clear negative title beats a product or review result.
    Fewer than ``least_chars`` characters besides white space don't decide.
    Pages after the deciding one aren't matched; ``n_read`` counts those that
    were. Without a decision ``page`` is null and the label is review. A null
    page is empty; titles are the same in all rows of a key. A key's pages
    are cut to the first ``most`` before they are shuffled.
    """
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    first = pages.select(key, F.col(page_col).alias("page"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), title.alias("title"))
    first = first.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy("page"))).filter(F.col("__rn") <= most)
    rows = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__rn", "page", "text"))).alias("pages"), F.max("title").alias("title"))
    rows = classify(rows, "title", rules, "veto").withColumn("has_title", F.coalesce(F.col("title"), F.lit("")) != "")
    either, strong = focus_patterns(rules)

    def named(text: Column) -> Column:
        return bind(sentences(text, newline_only), lambda parts: F.filter(parts, lambda s: matches(s, either)))

    nothing = bind(F.lit(""), lambda t: page_evidence(t, rules))
    page_kind = first.schema["page"].dataType
    start = F.struct(
        F.lit("").alias("carry"), F.lit("").alias("focus_carry"), F.lit(0).alias("used"), F.lit(0).alias("seen"), F.lit(False).alias("ended"), F.lit(False).alias("any_named"), F.lit(False).alias("any_strong"),
        nothing.alias("whole"), nothing.alias("focus"), F.lit(None).cast(page_kind).alias("page"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("n_read"),
    )

    def step(acc: Column, x: Column) -> Column:
        added = F.when(acc["n_read"] == 0, x["text"]).otherwise(F.concat(F.lit("\n"), x["text"]))
        before = F.get(F.split(added, marker, 2), F.lit(0)) if marker else added
        found_marker = F.size(F.split(added, marker, 2)) > 1 if marker else F.lit(False)
        taken = F.when(acc["ended"], F.lit("")).otherwise(before.substr(F.lit(1), F.greatest(F.lit(budget) - acc["used"], F.lit(0))))

        def with_text(cut: Column) -> Column:
            used = acc["used"] + F.length(cut)
            seen = acc["seen"] + F.length(F.regexp_replace(x["text"], r"\s", ""))
            return bind(_closed_and_open(F.concat(acc["carry"], cut)), lambda parts: with_parts(parts, used, seen))

        def with_parts(parts: Column, used: Column, seen: Column) -> Column:
            clean = F.transform(F.array(parts["closed"], parts["open"]), lambda t: stripped(t, rules.incidental))
            names = F.transform(clean, lambda t: named(t))
            both = F.struct(clean.alias("clean"), names.alias("names"))
            return bind(both, lambda b: with_names(parts, used, seen, b))

        def with_names(parts: Column, used: Column, seen: Column, b: Column) -> Column:
            closed_names, open_names = F.get(b["names"], F.lit(0)), F.get(b["names"], F.lit(1))
            focus = _closed_and_open(_joined(acc["focus_carry"], F.array_join(closed_names, "\n")))
            return bind(focus, lambda f: with_focus(parts, used, seen, b, closed_names, open_names, f))

        def with_focus(parts: Column, used: Column, seen: Column, b: Column, closed_names: Column, open_names: Column, f: Column) -> Column:
            texts = F.array(F.get(b["clean"], F.lit(0)), f["closed"], F.get(b["clean"], F.lit(1)), _joined(f["open"], F.array_join(open_names, "\n")))
            found = F.transform(texts, lambda t: page_evidence(t, rules))
            return bind(found, lambda e: with_evidence(parts, used, seen, closed_names, open_names, f, e))

        def with_evidence(parts: Column, used: Column, seen: Column, closed_names: Column, open_names: Column, f: Column, e: Column) -> Column:
            any_named = acc["any_named"] | (F.size(closed_names) > 0)
            any_strong = acc["any_strong"] | F.exists(closed_names, lambda s: matches(s, strong))
            on_items = (any_named | (F.size(open_names) > 0)) & ~any_strong & ~F.exists(open_names, lambda s: matches(s, strong))
            whole, focus = merged(acc["whole"], F.get(e, F.lit(0))), merged(acc["focus"], F.get(e, F.lit(1)))
            judged = F.when(on_items, merged(focus, F.get(e, F.lit(3)))).otherwise(merged(whole, F.get(e, F.lit(2))))

            def ended_at(result: Column) -> Column:
                sure = (seen >= least_chars) & ~result["needs_review"]
                ended = acc["ended"] | found_marker | (used >= budget)
                return F.struct(
                    parts["open"].alias("carry"), f["open"].alias("focus_carry"), used.alias("used"), seen.alias("seen"), ended.alias("ended"), any_named.alias("any_named"), any_strong.alias("any_strong"),
                    whole.alias("whole"), focus.alias("focus"), F.when(sure, x["page"]).alias("page"), F.when(sure, label(result)).alias("label"), (acc["n_read"] + 1).alias("n_read"),
                )

            document = bind(judged, lambda j: decided(j, rules))
            return bind(bind(document, lambda d: F.when(F.col("has_title"), vetoed(d, F.col("veto"))).otherwise(d)), ended_at)

        return F.when(acc["label"].isNotNull(), acc).otherwise(bind(taken, with_text))

    done = rows.select(key, F.aggregate("pages", start, step).alias("end"))
    return done.select(key, "end.page", F.coalesce("end.label", F.lit("review")).alias("label"), "end.n_read")
