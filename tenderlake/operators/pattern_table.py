"""Patterns as rows of a table, applied to texts in one pass.

However many rows there are, the plan is the same: a job over the texts that
gets the rows as a broadcast. A worker compiles a pattern once, when a text
first holds its anchor, a plain word without which it can't match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean

#: Rows of configuration that are read to the driver and broadcast; a larger table is an error.
MOST_ROWS = 100_000
#: What a pattern may open with so that a match begins just before a word, in any case: the start of the text or no letter, digit or underscore.
OPENINGS = ("(?i)(?:^|[^a-z0-9_])", "(?i)(?:^|[^A-Za-z0-9_])", "(?i)(^|[^a-z0-9_])", "(?i)(^|[^A-Za-z0-9_])")
_WORD = re.compile("[A-Za-z0-9_]+")
#: Hits that a worker holds before it hands them on.
HELD_HITS = 20_000
#: Columns of a table of patterns; ``anchor`` may be null, and then every text is searched.
COLUMNS = ("rule_set", "step", "label", "pattern", "anchor")


def pattern_rows(table: DataFrame) -> list[tuple]:
    """The checked rows ``rule_set, step, label, pattern, anchor`` of a table, in order.

    A row without a set, label or pattern, a pattern that doesn't compile or
    matches the empty text, and more than ``MOST_ROWS`` rows are errors.
    """
    rows = [tuple(r) for r in table.select(*COLUMNS).orderBy("rule_set", "step", "label", "pattern").limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} patterns")
    for name, step, label, pattern, _ in rows:
        if not name or step is None or label is None or not pattern:
            raise ValueError(f"incomplete pattern: {(name, step, label, pattern)}")
        if re.compile(pattern, re.ASCII).match(""):
            raise ValueError(f"matches nothing at all: {pattern}")
    return rows


def _opens_with(pattern: str, anchor: str) -> bool:
    """Whether each match of ``pattern`` begins with an edge and then ``anchor``, a plain word, so that the words of a text tell where."""
    rest = next((pattern[len(o) :] for o in OPENINGS if pattern.startswith(o)), "")
    if not _WORD.fullmatch(anchor) or rest[: len(anchor)].lower() != anchor:
        return False
    rest = rest[len(anchor) :]
    return "|" not in rest and rest[:1] not in ("?", "*", "+", "{")


def _matches_before(search: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """What ``finditer`` gives of a pattern that ``_opens_with`` a word, if that begins words at ``places`` only."""
    end = 0
    for place in places:
        start = max(place - 1, 0)
        if start >= end and (m := search.match(text, start)):
            end = m.end()
            yield m


def pattern_hits(df: DataFrame, key: str, text_col: str, rows: list[tuple], every: bool = True) -> DataFrame:
    """``key, rule_set, step, label, pos, quote, parts`` of each match of each pattern, or of its first one only (not ``every``).

    Patterns are Python's, with ASCII classes; case matters unless a pattern
    starts with ``(?i)``. ``parts`` are its groups, null where one has no part.
    Anchors are looked for in the lower-cased text. Where a pattern opens with
    an edge (``OPENINGS``) and its anchor, a text's words are looked up among
    the anchors, and only these places are matched, so that thousands of such
    patterns cost one pass. Null texts have no match.
    """
    shared = df.sparkSession.sparkContext.broadcast(rows)
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "rule_set", "step", "label", "pos", "quote", "parts"]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, re.Pattern] = {}
        by_anchor: dict[str, list[tuple]] = {}
        by_word: dict[str, list[tuple]] = {}
        for row in shared.value:
            anchor = (row[4] or "").lower()
            (by_word if _opens_with(row[3], anchor) else by_anchor).setdefault(anchor, []).append(row)
        lengths = sorted({len(w) for w in by_word})

        def matches(text: str) -> Iterator[tuple[tuple, Iterator[re.Match]]]:
            search = lambda p: compiled.get(p) or compiled.setdefault(p, re.compile(p, re.ASCII))
            low = text.lower()
            for anchor, several in by_anchor.items():
                if anchor in low:
                    yield from ((row, search(row[3]).finditer(text)) for row in several)
            at: dict[str, list[int]] = {}
            for m in _WORD.finditer(text) if by_word else ():
                word = m.group().lower()
                for n in lengths:
                    if n > len(word):
                        break
                    if word[:n] in by_word:
                        at.setdefault(word[:n], []).append(m.start())
            for anchor, places in at.items():
                yield from ((row, _matches_before(search(row[3]), text, places)) for row in by_word[anchor])

        for batch in batches:
            at: list[int] = []
            found: list[list] = [[] for _ in names[1:]]
            ready = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names)  # noqa: E731, B023
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                for (name, step, label, _, _), hits in matches(text):
                    for n, m in enumerate(hits):
                        at.append(i)
                        for cell, value in zip(found, (name, step, label, n, m.group(0), list(m.groups())), strict=True):
                            cell.append(value)
                        if not every:
                            break
                        if len(at) >= HELD_HITS:
                            yield ready()
                            at, found = [], [[] for _ in names[1:]]
            yield ready()

    out = df.select(key, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"key {kind}, rule_set string, step int, label string, pos int, quote string, parts array<string>")
    return out.withColumnRenamed("key", key)


def table_labels(df: DataFrame, key: str, text_col: str, rows: list[tuple]) -> DataFrame:
    """T3 from a table: per key and rule set the label of the first step that matches: ``key, rule_set, label``."""
    hits = pattern_hits(df, key, text_col, rows, every=False)
    return hits.groupBy(key, "rule_set").agg(F.min_by("label", F.struct("step", "label")).alias("label"))


def table_items(df: DataFrame, key: str, text_col: str, rows: list[tuple], constants: DataFrame, source: Column) -> DataFrame:
    """E15 from a table: the items that templates find, none of them merged.

    Groups 1 and 2 of a template are quantity and duration. ``constants`` has
    per ``label`` the ``description``, ``unit``, ``license_type`` and whether
    units are licenses (``counts_licenses``); it is joined by label. Returns
    ``key, item_no, template, description, quantity, unit, licenses, duration,
    license_type, confidence, source, quote``; items of a document are
    numbered by step and place. A quantity that isn't a number is null, and
    confidence is then medium.
    """
    hits = pattern_hits(df, key, text_col, rows)
    sources = df.select(F.col(key).alias("__k"), source.alias("source"))
    kept = hits.join(F.broadcast(constants.select(F.col("label").alias("__l"), "description", "unit", "license_type", "counts_licenses")), F.col("label") == F.col("__l"))
    quantity = F.regexp_replace(F.get("parts", F.lit(0)), ",", "").try_cast("double")
    order = F.row_number().over(Window.partitionBy(key).orderBy("step", "label", "pos"))
    found = kept.select(
        key, order.alias("item_no"), F.col("label").alias("template"), "description", quantity.alias("quantity"), "unit", F.when(F.col("counts_licenses"), quantity).alias("licenses"),
        F.nullif(clean(F.get("parts", F.lit(1))), F.lit("")).alias("duration"), "license_type", F.when(quantity.isNull(), "medium").otherwise("high").alias("confidence"), "quote",
    )
    return found.join(sources, F.col(key) == F.col("__k")).drop("__k")

