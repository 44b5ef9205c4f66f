"""Rule-based classification of texts: one decision list, and what is built on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CONTEXT, RuleSet, context_flags, excerpt, first_label, has, matches, stripped, terms_found
from ..functions.text import bind
from .relational import planned_rows

#: Outcome of a decision: relevant, needs review, confidence, category.
PRODUCT = (True, False, 0.9, "product")
NOT_RELEVANT = (False, False, 0.9, "not relevant")
REVIEW = (False, True, 0.4, "unknown")
GOODS = (False, False, 0.9, "goods")
MIXED = (False, True, 0.5, "mixed")
UNKNOWN = (False, True, 0.3, "unknown")


def evidence(df: DataFrame, text_col: str, rules: RuleSet, prefix: str = "") -> DataFrame:
    """Adds the stripped text, terms, labels and flags that decisions rest on, in staged projections."""
    p = prefix
    out = df.withColumn(f"{p}source", stripped(F.coalesce(F.col(text_col), F.lit("")), rules.incidental))
    source = F.col(f"{p}source")
    out = out.withColumns({f"{p}products": terms_found(source, rules.product_terms), f"{p}goods": terms_found(source, rules.goods_terms)})
    out = out.withColumns(
        {
            f"{p}excluded": first_label(source, rules.excluded),
            f"{p}service": first_label(source, rules.services),
            f"{p}physical": first_label(source, rules.physical),
            f"{p}category_label": first_label(source, rules.categories),
            **{f"{p}has_{name}": has(source, rules, name) for name in CONTEXT},
        }
    )
    flags = context_flags(rules, F.col(f"{p}products"), F.col(f"{p}goods"), lambda name: F.col(f"{p}has_{name}"))
    return out.withColumns({f"{p}is_{k}": v for k, v in flags.items()})


def decision(prefix: str = "") -> Column:
    """T6 over the columns that ``evidence`` adds."""
    return decision_by(lambda name: F.col(f"{prefix}{name}"))


def decision_by(c: Callable[[str], Column]) -> Column:
    """The first step that applies, as ``struct(rule, is_relevant, needs_review, confidence, category)``.

    ``c`` gives the terms, labels and flags by name. A product found by one
    weak term alone has confidence 0.75.
    """
    is_ = lambda name: c(f"is_{name}")
    category = c("category_label").isNotNull()
    only_goodsless = ~is_("any_goods")
    steps = [
        ("excluded product", c("excluded").isNotNull(), NOT_RELEVANT),
        ("telecom", is_("telecom"), NOT_RELEVANT),
        ("connectivity", is_("connectivity"), NOT_RELEVANT),
        ("event", is_("event"), NOT_RELEVANT),
        ("consulting", is_("consulting"), NOT_RELEVANT),
        ("consulting with purchase", is_("consulting_mixed"), REVIEW),
        ("service", c("service").isNotNull() & ~is_("strong"), NOT_RELEVANT),
        ("service with product", c("service").isNotNull(), REVIEW),
        ("physical", c("physical").isNotNull() & ~is_("strong"), NOT_RELEVANT),
        ("physical with product", c("physical").isNotNull(), REVIEW),
        ("category with product", category & (is_("dedicated") | is_("purchase")), REVIEW),
        ("category", category & is_("generic_at_most"), NOT_RELEVANT),
        ("category unclear", category, REVIEW),
        ("dedicated product", is_("dedicated") & only_goodsless, PRODUCT),
        ("weak term in context", is_("weak_only") & only_goodsless & is_("subscription_context"), PRODUCT),
        ("weak term", is_("weak_only") & only_goodsless, REVIEW),
        ("license", ~is_("any_product") & only_goodsless & is_("license_object"), PRODUCT),
        ("product terms", is_("any_product") & only_goodsless, PRODUCT),
        ("goods terms", is_("any_goods") & ~is_("any_product"), GOODS),
        ("both", is_("any_goods") & is_("any_product"), MIXED),
    ]
    lone_weak = is_("weak_only") & (F.size(c("products")) == 1)
    sure = lambda o: F.when(lone_weak, 0.75).otherwise(o[2]) if o is PRODUCT else F.lit(o[2])
    outcome = lambda rule, o: F.struct(
        F.lit(rule).alias("rule"), F.lit(o[0]).alias("is_relevant"), F.lit(o[1]).alias("needs_review"), sure(o).alias("confidence"), F.lit(o[3]).alias("category")
    )
    chain = None
    for rule, condition, result in steps:
        chain = F.when(condition, outcome(rule, result)) if chain is None else chain.when(condition, outcome(rule, result))
    return chain.otherwise(outcome("no terms", UNKNOWN))


def classify(df: DataFrame, text_col: str, rules: RuleSet, out_col: str = "relevance", keep: bool = False) -> DataFrame:
    """``df`` with the decision on ``text_col``; the evidence columns stay if ``keep``."""
    found = evidence(df, text_col, rules, "__e_").withColumn(out_col, decision("__e_"))
    return found if keep else found.drop(*(c for c in found.columns if c.startswith("__e_")))


def reasons(rules: RuleSet, most: int = 4) -> Column:
    """Excerpts around the first terms found, from the columns that ``classify(keep=True)`` leaves."""
    quoted = [
        F.when(F.array_contains(F.slice(f"__e_{col}", 1, most), t), F.concat(F.lit(f"{t}: "), excerpt(F.col("__e_source"), t)))
        for col, terms in (("products", rules.product_terms), ("goods", rules.goods_terms))
        for t in terms
    ]
    return F.array_compact(F.array(*quoted))


#: What a rule says where it isn't explained by the terms it quotes; a label may follow.
SENTENCES = {
    "excluded product": "an excluded product",
    "telecom": "a subscription to a connection",
    "connectivity": "connection hardware, products only in passing",
    "event": "an event that names a development",
    "consulting": "a consulting engagement without a purchase",
    "consulting with purchase": "a consulting engagement with a purchase",
    "service": "a service",
    "service with product": "a service, and products",
    "physical": "physical goods",
    "physical with product": "physical goods, and products",
    "category with product": "a business category of other things, and a purchase",
    "category": "a business category of other things",
    "category unclear": "a business category of other things, and products",
    "weak term": "a weak term without its context",
    "no terms": "no known terms",
}
QUOTING = ("dedicated product", "weak term in context", "license", "product terms", "goods terms", "both")


def explained(relevance: Column, rules: RuleSet) -> tuple[Column, Column]:
    """``reasons`` and ``notes`` of a result, from the columns that ``classify(keep=True)`` leaves.

    Rules that rest on terms quote them; the others say what was found. Notes
    name the label of the family that matched, or the first three terms.
    """
    rule = relevance["rule"]
    said = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    why = F.when(rule.isin(*QUOTING), reasons(rules)).otherwise(F.array(F.element_at(said, rule)))
    family = F.when(rule == "excluded product", F.col("__e_excluded")).when(rule.startswith("service"), F.col("__e_service"))
    family = family.when(rule.startswith("physical"), F.col("__e_physical")).when(rule.startswith("category"), F.col("__e_category_label"))
    terms = F.when(relevance["is_relevant"] & (F.size("__e_products") > 0), F.array_join(F.slice("__e_products", 1, 3), ", "))
    return why, F.array_compact(F.array(F.coalesce(family, terms)))


def without_document(relevance: Column) -> Column:
    """The result of a title when the document can't be read: for review, with confidence 0.35."""
    forced = F.lit(True).alias("needs_review")
    return F.struct(
        F.concat(F.lit("unreadable, "), relevance["rule"]).alias("rule"), F.lit(False).alias("is_relevant"), forced,
        F.lit(0.35).alias("confidence"), relevance["category"].alias("category"),
    )


def structured_result(relevance: Column, prefix: str = "__e_") -> Column:
    """A product found in structured fields by the generic term, with nothing bought by name, is for review."""
    review = F.struct(
        F.lit("generic term alone").alias("rule"), F.lit(False).alias("is_relevant"), F.lit(True).alias("needs_review"),
        F.lit(REVIEW[2]).alias("confidence"), F.lit(REVIEW[3]).alias("category"),
    )
    return F.when(relevance["is_relevant"] & F.col(f"{prefix}is_generic_alone"), review).otherwise(relevance)


def vetoed(document: Column, title: Column) -> Column:
    """A clear negative title beats a product or review result of the document."""
    clear = ~title["is_relevant"] & ~title["needs_review"]
    return F.when(clear & (document["is_relevant"] | document["needs_review"]), title).otherwise(document)


def label(relevance: Column) -> Column:
    """Product, review or not relevant."""
    return F.when(relevance["is_relevant"], "product").when(relevance["needs_review"], "review").otherwise("not relevant")


def title_action(relevance: Column) -> Column:
    """What a title's result leads to."""
    return F.when(relevance["is_relevant"], "download").when(relevance["needs_review"], "inspect").otherwise("skip")


def inspection_outcome(relevance: Column) -> Column:
    """What an inspected document's result leads to."""
    return F.when(relevance["is_relevant"], "product").when(relevance["needs_review"], "unclear").otherwise("skip")


def sentences(text: Column, newline_only: bool = False) -> Column:
    """Sentences of a text, trimmed, none empty."""
    pattern = r"\n+" if newline_only else r"\n+|(?<=[.!?])\s+|•"
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda s: F.trim(s)), lambda s: s != "")


def focus_patterns(rules: RuleSet) -> tuple[str, str]:
    """What names an item (a service or a goods term), and what names a strong product term."""
    words = lambda terms: [r"\s+".join(t.split()) + "s?" for t in terms]
    return "|".join([p for _, p in rules.services] + words(rules.goods_terms)), "|".join(words(rules.strong_terms))


def item_focus(parts: Column, rules: RuleSet, whole: Column | None = None) -> Column:
    """Sentences that name a service or a goods term; if there are none, or one of them names a strong
    product term too, the whole text (all sentences, if it isn't given). Physical goods don't count."""
    either, strong = focus_patterns(rules)
    everything = F.array_join(parts, "\n") if whole is None else whole
    focused = F.filter(parts, lambda s: matches(s, either))
    return bind(focused, lambda f: F.when((F.size(f) > 0) & ~F.exists(f, lambda s: matches(s, strong)), F.array_join(f, "\n")).otherwise(everything))


def title_words(title: Column, stop_words: tuple[str, ...], shortest: int = 5) -> Column:
    """Distinct lower-case words of a title of some length, in order, without stop words."""
    found = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0))
    stops = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= shortest) & ~F.array_contains(stops, w)))


def word_tokens(text: Column) -> Column:
    """The lower-case runs of letters, digits and underscores of a text: what stands between boundaries."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def with_plurals(words: Column) -> Column:
    """Words and the same with an ``s``."""
    return F.concat(words, F.transform(words, lambda w: F.concat(w, F.lit("s"))))


def related_passages(parts: Column, words: Column) -> Column:
    """Sentences that hold any of the words, or its plural, as a whole word; all of them if there are no words."""
    holds = bind(with_plurals(words), lambda ws: F.filter(parts, lambda s: F.arrays_overlap(word_tokens(s), ws)))
    return F.when(F.size(words) == 0, parts).otherwise(holds)


def identifiers(text: Column, pattern: str) -> Column:
    """Identifiers in a text, upper-cased, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.upper(x)))


def sections_of(text: Column, marker: str, id_group: int = 1) -> Column:
    """Sections ``struct(id, text)`` of a text that is split before each ``marker``; chunks of one id are joined by lines, in order."""
    named = F.filter(
        F.transform(F.split(text, f"(?={marker})"), lambda c: F.struct(F.upper(F.regexp_extract(c, marker, id_group)).alias("id"), c.alias("text"))),
        lambda x: x["id"] != "",
    )

    def joined(chunks: Column) -> Column:
        of = lambda i: F.transform(F.filter(chunks, lambda x: x["id"] == i), lambda x: x["text"])
        ids = F.array_distinct(F.transform(chunks, lambda x: x["id"]))
        return F.transform(ids, lambda i: F.struct(i.alias("id"), F.array_join(of(i), "\n").alias("text")))

    return bind(named, joined)


def best_section(text: Column, words: Column, ids: Column, marker: str, id_group: int = 1) -> Column:
    """The section that fits a title, as ``struct(section_id, score, n_sections, uncertain, section)``.

    A section whose id is one of ``ids`` scores 100; any other scores the
    title words (or their plurals) it holds that not all sections hold. With
    fewer than two sections the whole text is the section. A best score of 0,
    or a tie below 100, is uncertain and leaves no text. All of it is within
    the row, so nothing is shuffled.
    """

    def held(words: Column, section: Column) -> Column:
        return bind(word_tokens(section), lambda ts: F.filter(words, lambda w: F.array_contains(ts, w) | F.array_contains(ts, F.concat(w, F.lit("s")))))

    def chosen(sections: Column, ranks: Column) -> Column:
        best, second = F.get(ranks, F.lit(0)), F.get(ranks, F.lit(1))
        unsure = (best["score"] <= 0) | (F.coalesce(second["score"], F.lit(-1)) == best["score"]) & (best["score"] < 100)
        section = F.get(sections, -best["pos"])
        return F.struct(
            section["id"].alias("section_id"), best["score"].alias("score"), F.size(sections).cast("bigint").alias("n_sections"),
            unsure.alias("uncertain"), F.when(unsure, "").otherwise(section["text"]).alias("section"),
        )

    def ranked(sections: Column, words: Column) -> Column:
        def scores(h: Column) -> Column:
            shared = F.filter(words, lambda w: F.forall(h, lambda a: F.array_contains(a, w)))
            own = lambda a, i, sh: F.when(F.array_contains(ids, F.get(sections, i)["id"]), 100).otherwise(F.size(F.array_except(a, sh)))
            return bind(shared, lambda sh: F.transform(h, lambda a, i: F.struct(own(a, i, sh).alias("score"), (-i).alias("pos"))))

        found = bind(F.transform(sections, lambda x: held(words, x["text"])), scores)
        return bind(F.reverse(F.sort_array(found)), lambda r: chosen(sections, r))

    def picked(sections: Column) -> Column:
        null = lambda kind: F.lit(None).cast(kind)
        whole = F.struct(
            null("string").alias("section_id"), null("int").alias("score"), F.size(sections).cast("bigint").alias("n_sections"),
            F.lit(False).alias("uncertain"), F.coalesce(text, F.lit("")).alias("section"),
        )
        return F.when(F.size(sections) < 2, whole).otherwise(bind(words, lambda w: ranked(sections, w)))

    return bind(sections_of(F.coalesce(text, F.lit("")), marker, id_group), picked)


def best_sections(df: DataFrame, key: str, text_col: str, words_col: str, marker: str, id_group: int = 1, ids_col: str | None = None) -> DataFrame:
    """T16 for each row: ``key, section_id, score, n_sections, uncertain, section``."""
    ids = F.col(ids_col) if ids_col else F.array().cast("array<string>")
    return df.select(key, best_section(F.col(text_col), F.col(words_col), ids, marker, id_group).alias("__best")).select(key, "__best.*")


def classify_document(df: DataFrame, text_col: str, title_col: str, rules: RuleSet, marker: str, stop_words: tuple[str, ...], id_group: int = 1, newline_only: bool = False, out_col: str = "relevance", passed_over: tuple[str, ...] = ()) -> DataFrame:
    """A document's result for the notice of a title, as ``classify`` gives it, ``section_id`` and ``notes``.

    Incidental phrases go, the section of the notice is selected (by ids that
    the title names, then by its words), item sentences are focused on, the
    rest is classified, and a clear negative title beats a product or review
    result. A document whose section is uncertain is for review. Notes say
    which section was taken, which others name products (other than those
    ``passed_over``), and that a title's exclusion stands.
    """
    title = F.coalesce(F.col(title_col), F.lit(""))
    ids = bind(F.split(title, f"(?={marker})"), lambda cs: F.transform(cs, lambda c: F.upper(F.regexp_extract(c, marker, id_group))))
    rows = df.withColumn("__clean", stripped(F.coalesce(F.col(text_col), F.lit("")), rules.incidental))
    rows = rows.withColumn("__best", best_section(F.col("__clean"), title_words(title, stop_words), F.filter(ids, lambda i: i != ""), marker, id_group))
    rows = rows.withColumn("__focus", bind(sentences(F.col("__best.section"), newline_only), lambda parts: item_focus(parts, rules, F.col("__best.section"))))
    rows = classify(classify(rows, "__focus", rules, "__document"), title_col, rules, "__title")
    unsure = F.struct(
        F.lit("section unclear").alias("rule"), F.lit(False).alias("is_relevant"), F.lit(True).alias("needs_review"),
        F.lit(REVIEW[2]).alias("confidence"), F.lit(REVIEW[3]).alias("category"),
    )
    judged = F.when(title != "", vetoed(F.col("__document"), F.col("__title"))).otherwise(F.col("__document"))
    result = F.when(F.col("__best.uncertain"), unsure).otherwise(judged)
    stands = ~F.col("__best.uncertain") & (title != "") & (F.col("__document.is_relevant") | F.col("__document.needs_review")) & ~F.col("__title.is_relevant") & ~F.col("__title.needs_review")
    sections = F.when(F.col("__best.n_sections") >= 2, section_notes(F.col("__clean"), F.col("__best"), rules, marker, id_group, passed_over)).otherwise(F.array().cast("array<string>"))
    notes = F.concat(sections, F.when(stands, F.array(F.lit("the title's exclusion stands"))).otherwise(F.array().cast("array<string>")))
    return rows.select(*df.columns, F.col("__best.section_id").alias("section_id"), notes.alias("notes"), result.alias(out_col))


def section_notes(text: Column, best: Column, rules: RuleSet, marker: str, id_group: int = 1, passed_over: tuple[str, ...] = ()) -> Column:
    """What is said about the choice of a section, and about other sections that name product terms."""
    telling = tuple(t for t in rules.product_terms if t not in passed_over)
    others = lambda xs: F.filter(xs, lambda x: (x["id"] != best["section_id"]) & (F.size(terms_found(x["text"], telling)) > 0))
    named = bind(sections_of(text, marker, id_group), lambda xs: F.transform(others(xs), lambda x: F.concat(F.lit("products in another section: "), x["id"])))
    taken = F.concat(F.array(F.concat(F.lit("section "), best["section_id"])), named)
    return F.when(best["uncertain"], F.array(F.lit("no one section of this notice"))).otherwise(taken)


def reclassified_by_text(
    packets: DataFrame, title_col: str, source_col: str, label_col: str, text_col: str, has_files: Column, rules: RuleSet, marker: str, stop_words: tuple[str, ...], **document
) -> DataFrame:
    """A packet's new label from what is stored: adds ``basis``, ``new_label`` and ``to_download``.

    A manual decision stays (manual). A clear title decides (title); a product
    without files is to be downloaded. Otherwise the saved text is classified
    as a document (text), and without one the label stays until a document
    has been inspected (needs document). Saved text that is empty is text.
    """
    rows = classify(packets, title_col, rules, "__named")
    manual = F.coalesce(F.col(source_col) == "manual", F.lit(False))
    open_ = ~manual & F.col("__named.needs_review")
    rows = rows.withColumn("__saved", F.when(open_ & F.col(text_col).isNotNull(), F.col(text_col)).otherwise(""))
    rows = classify_document(rows, "__saved", title_col, rules, marker, stop_words, out_col="__read", **document)
    basis = F.when(manual, "manual").when(~F.col("__named.needs_review"), "title").when(F.col(text_col).isNotNull(), "text").otherwise("needs document")
    new = F.when(basis == "title", label(F.col("__named"))).when(basis == "text", label(F.col("__read"))).otherwise(F.col(label_col))
    return rows.select(*packets.columns, basis.alias("basis"), new.alias("new_label"), ((basis == "title") & (new == "product") & ~has_files).alias("to_download"))


def usable(text: Column, letters: int = 200) -> Column:
    """Whether a text has enough ASCII letters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")) >= letters


def portion(text: Column, marker: str, budget: int = 4_000) -> Column:
    """The text before a form marker, cut to a budget of characters."""
    return F.substring(F.get(F.split(F.coalesce(text, F.lit("")), marker, 2), F.lit(0)), 1, budget)


def classify_structured(df: DataFrame, text_col: str, title_col: str, rules: RuleSet, marker: str, stop_words: tuple[str, ...], out_col: str = "relevance", **document) -> DataFrame:
    """``classify_document`` on the text of structured fields; a product that rests on the generic term alone, in all of the text, is for review."""
    rows = classify_document(df, text_col, title_col, rules, marker, stop_words, out_col="__judged", **document)
    # only products are looked at again; the patterns pass over an empty text
    again = rows.withColumn("__all", F.when(F.col("__judged.is_relevant"), F.col(text_col)).otherwise(""))
    done = classify(again, "__all", rules, "__whole", keep=True).withColumn(out_col, structured_result(F.col("__judged")))
    return done.select(*df.columns, "section_id", "notes", out_col)


def cascade(df: DataFrame, title_col: str, structured_col: str, rules: RuleSet, marker: str, stop_words: tuple[str, ...], **document) -> DataFrame:
    """The title decides if it can; only undecided rows look at their structured fields, as T9 does.

    Adds ``phase`` (title-skip, title-download, structured-skip,
    structured-download, inspect), ``rule`` and ``category``. Without text in
    its fields an undecided row keeps the title's result and is to inspect.
    """
    titled = classify(df, title_col, rules, "__title")
    open_ = F.col("__title.needs_review")
    done = titled.filter(~open_).select(
        *df.columns, F.concat(F.lit("title-"), title_action(F.col("__title"))).alias("phase"), "__title.rule", "__title.category"
    )
    second = classify_structured(titled.filter(open_), structured_col, title_col, rules, marker, stop_words, "__fields", **document)
    blank = F.trim(F.coalesce(F.col(structured_col), F.lit(""))) == ""
    second = second.withColumn("__fields", F.when(blank, F.col("__title")).otherwise(F.col("__fields")))
    phase = F.when(F.col("__fields.needs_review"), "inspect").otherwise(F.concat(F.lit("structured-"), title_action(F.col("__fields"))))
    return done.unionByName(second.select(*df.columns, phase.alias("phase"), "__fields.rule", "__fields.category"))


def scan_plan(incoming: DataFrame, state: DataFrame, key: str, title_col: str, rules: RuleSet) -> DataFrame:
    """Skip, reuse or process for each incoming row.

    ``state`` has one row a key with ``is_manual`` and ``reusable``. A manual
    decision is reused; then a clear negative title is skipped, even if a
    saved result could be reused.
    """
    rows = classify(incoming, title_col, rules, "__title")
    skip = title_action(F.col("__title")) == "skip"
    return planned_rows(rows, state, key, key, skip).select(*incoming.columns, "plan")


def review_without_documents(phase: Column, portal: Column) -> tuple[Column, Column]:
    """``phase`` and ``reason``: a notice of the second portal that needs its document is for review, and says why."""
    forced = (phase == "inspect") & (portal == "legacy")
    return F.when(forced, "review").otherwise(phase).alias("phase"), F.when(forced, "its documents are not public").alias("reason")
