"""Rules as data: term lists, phrase lists and ordered families, and the columns they give.

Rules avoid lookaround and ``\\b``, so that they mean the same in any engine; a
boundary is anything but an ASCII letter, digit or underscore.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]"
EDGE = "[^A-Za-z0-9_]"


def bounded(pattern: str) -> str:
    """``pattern`` between boundaries, in any case."""
    return f"(?i)(^|{EDGE})({pattern})($|{EDGE})"


def term_pattern(term: str) -> str:
    """A term with any white space between its words and an optional plural."""
    return bounded(r"\s+".join(term.split()) + "s?")


@dataclass(frozen=True)
class RuleSet:
    """What a classifier knows. Families are ordered (label, pattern) pairs; the first that matches gives the label.

    Three product terms have a role of their own: the one that a subscription
    condition needs, the generic one that proves nothing alone, and the one
    that events name without buying it.
    """

    product_terms: tuple[str, ...]
    goods_terms: tuple[str, ...]
    weak_terms: tuple[str, ...] = ()
    incidental: tuple[str, ...] = ()
    excluded: tuple[tuple[str, str], ...] = ()
    services: tuple[tuple[str, str], ...] = ()
    physical: tuple[tuple[str, str], ...] = ()
    categories: tuple[tuple[str, str], ...] = ()
    context: dict[str, str] = field(default_factory=dict)
    subscription_term: str = ""
    generic_term: str = ""
    event_term: str = ""

    def __hash__(self) -> int:
        return id(self)

    @property
    def strong_terms(self) -> tuple[str, ...]:
        return tuple(t for t in self.product_terms if t not in self.weak_terms)


#: Rules for procurement notices in English, written for this engine.
PROCUREMENT = RuleSet(
    product_terms=("software", "license key", "antivirus", "database system", "web application", "erp", "saas", "subscription", "information system", "system development"),
    goods_terms=("laptop", "printer", "server rack", "router", "keyboard", "toner"),
    weak_terms=("subscription", "information system"),
    incidental=(r"software[- ]based\s+training", r"compatible\s+with\s+any\s+software", r"softwares?\s+not\s+included"),
    excluded=(("surveillance cameras", r"cctv|surveillance\s+cameras?"), ("firewall appliance", r"firewall\s+appliances?")),
    services=(("catering", r"catering|meals?\s+and\s+snacks?"), ("janitorial work", r"janitorial|cleaning\s+services?"), ("repair work", r"repairs?\s+of|repainting")),
    physical=(("furniture", r"tables?\s+and\s+chairs?|furniture"), ("vehicle parts", r"tires?|spare\s+parts?"), ("medicine", r"medicines?|vaccines?")),
    categories=(("construction", r"category:\s*construction"), ("food stuff", r"category:\s*food")),
    context={
        "telecom": r"internet\s+(subscription|plan)|mobile\s+data\s+plan",
        "connectivity": r"satellite\s+internet|leased\s+line",
        "event": r"workshop|seminar|team\s+building",
        "consulting": r"consulting\s+services|research\s+engagement",
        "purchase": r"(supply|delivery|procurement)\s+of\s+software",
        "dedicated": r"accounting\s+software|hospital\s+information\s+system|software\s+licenses?",
        "subscription_context": r"(annual|yearly|user)\s+subscription",
        "license": r"licenses?",
        "license_object": r"(per\s+user|activation|edition)",
        "hardware_bundle": r"laptops?|desktops?|servers?|computers?",
        "event_purchase": r"software\s+(subscription|licenses?)",
        "purchase_unit": r"licenses?|subscriptions?|seats?",
    },
    subscription_term="subscription",
    generic_term="software",
    event_term="system development",
)

#: Names of the context patterns that conditions read.
CONTEXT = (
    "telecom", "connectivity", "event", "consulting", "purchase", "dedicated", "subscription_context", "license", "license_object", "hardware_bundle", "event_purchase", "purchase_unit",
)


def needed_literals(pattern: str) -> list[str]:
    """Lower-case strings of which each match of ``pattern``, in any case, holds at least one; empty if that can't be told.

    Each alternative needs its longest run of plain letters, digits and
    spaces; what stands in groups or classes or is optional is passed over.
    """
    runs, run, depth, i = [[]], "", 0, 0
    while i <= len(pattern):
        c = pattern[i] if i < len(pattern) else "|"
        plain = depth == 0 and c.isascii() and (c.isalnum() or c == " ")
        if plain:
            run, i = run + c.lower(), i + 1
            continue
        if depth == 0 and run:
            # a quantifier that allows none takes the last letter away
            runs[-1].append(run[:-1] if c in "?*{" else run)
            run = ""
        if c == "\\":
            i += 2
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return []
            i = end + 1
            continue
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            runs.append([])
        i += 1
    longest = [max(r, key=len, default="") for r in runs[:-1]]
    return longest if depth == 0 and longest and all(len(x) > 1 for x in longest) else []


def matches(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs between boundaries.

    What any match needs is looked for in the lower-cased text first, then
    the pattern without boundaries; both are cheaper and mostly say no.
    """
    # the same boundaries as ``bounded`` has, but without a step of their own at every place
    found = text.rlike(f"(?i)(?:{pattern})") & text.rlike(f"(?i)(?<!{WORD})(?:{pattern})(?!{WORD})")
    literals = needed_literals(pattern)
    if not literals:
        return found
    return reduce(Column.__or__, (F.lower(text).contains(x) for x in literals)) & found


def terms_found(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur in ``text``, in the order of the list."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(matches(text, r"\s+".join(t.split()) + "s?"), F.lit(t)) for t in terms)))


def stripped(text: Column, phrases: tuple[str, ...]) -> Column:
    """``text`` with each incidental phrase replaced by a space."""
    for phrase in phrases:
        text = F.regexp_replace(text, f"(?i){phrase}", " ")
    return text


def first_label(text: Column, family: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first pattern of a family that occurs."""
    if not family:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.when(matches(text, p), F.lit(label)) for label, p in family))


def has(text: Column, rules: RuleSet, name: str) -> Column:
    """Whether a context pattern occurs; false where the rules have none."""
    pattern = rules.context.get(name)
    return matches(text, pattern) if pattern else F.lit(False)


def context_flags(rules: RuleSet, products: Column, goods: Column, hit: Callable[[str], Column]) -> dict[str, Column]:
    """T4 and T5: named conditions on the terms found in a stripped text and on its context patterns, ``hit(name)``."""
    weak = F.array(*map(F.lit, rules.weak_terms)) if rules.weak_terms else F.array().cast("array<string>")
    any_product, any_goods = F.size(products) > 0, F.size(goods) > 0
    strong_terms = F.array_except(products, weak)
    strong = F.size(strong_terms) > 0
    only = lambda term: ~F.exists(strong_terms, lambda t: t != term)
    weak_subscription = any_product & ~strong & F.array_contains(products, rules.subscription_term)
    dedicated = hit("dedicated")
    direct = hit("purchase") | (dedicated & hit("purchase_unit"))
    license_object = hit("license") & hit("license_object") & ~hit("hardware_bundle")
    in_context = weak_subscription & hit("subscription_context")
    return {
        "any_product": any_product,
        "any_goods": any_goods,
        "strong": strong,
        "weak_only": any_product & ~strong,
        "generic_at_most": only(rules.generic_term),
        "telecom": weak_subscription & hit("telecom"),
        "connectivity": hit("connectivity") & ~dedicated & only(rules.generic_term),
        "event": hit("event") & ~dedicated & ~hit("event_purchase") & strong & only(rules.event_term),
        "consulting": hit("consulting") & ~direct,
        "consulting_mixed": hit("consulting") & direct,
        "purchase": direct,
        "dedicated": dedicated,
        "subscription_context": in_context,
        "license_object": license_object,
        "generic_alone": strong & only(rules.generic_term) & ~dedicated & ~direct & ~license_object & ~in_context,
    }


def load_rules(table: DataFrame) -> RuleSet:
    """A rule set from rows ``rule_set, step, label, pattern``, read once per run.

    A few hundred rows of configuration; an unknown rule set or an empty
    pattern raises. Order is by step, then label.
    """
    rows = table.orderBy("rule_set", "step", "label").collect()
    known = {"product", "goods", "weak", "incidental", "excluded", "services", "physical", "categories", "context", "subscription", "generic", "event"}
    if bad := [r for r in rows if r["rule_set"] not in known or not r["pattern"]]:
        raise ValueError(f"bad rules: {bad[:3]}")
    take = lambda name: [r for r in rows if r["rule_set"] == name]
    plain = lambda name: tuple(r["pattern"] for r in take(name))
    pairs = lambda name: tuple((r["label"], r["pattern"]) for r in take(name))
    one = lambda name: next(iter(plain(name)), "")
    return RuleSet(
        plain("product"), plain("goods"), plain("weak"), plain("incidental"), pairs("excluded"),
        pairs("services"), pairs("physical"), pairs("categories"), dict(pairs("context")),
        one("subscription"), one("generic"), one("event"),
    )


def procurement_rules(spark: SparkSession) -> RuleSet:
    """The rules of ``data/procurement_rules.csv``, for notices in English; a copy of that file with other rows is another classifier."""
    text = (Path(__file__).resolve().parents[1] / "data" / "procurement_rules.csv").read_text(encoding="utf-8")
    rows = [(s, int(n), label, pattern) for s, n, label, pattern in csv.reader(text.splitlines()[1:], delimiter=";", quoting=csv.QUOTE_NONE)]
    return load_rules(spark.createDataFrame(rows, "rule_set string, step int, label string, pattern string"))


def excerpt(text: Column, term: str, around: int = 70) -> Column:
    """A term with ``around`` characters of white-space-collapsed text on either side, dots where it is cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    hit = F.regexp_extract(flat, term_pattern(term), 0)
    at = F.position(hit, flat)
    begin, end = F.greatest(at - around, F.lit(1)), F.least(at + F.length(hit) + around, F.length(flat) + 1)
    cut = F.concat(
        F.when(begin > 1, "...").otherwise(""), F.substring(flat, begin, end - begin), F.when(end <= F.length(flat), "...").otherwise("")
    )
    return F.when(hit != "", cut)
