"""Quality rules with adaptive thresholds, in DataFrame operations only.

Counts of each text are taken within its row. Quantile digests of four
ratios are built per language and source (and per language, and overall, as
the groups behind small groups); they merge from partial digests, so one
group may hold any share of the rows. A text is rejected where a ratio is
far outside the spread of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, materialise, small_side

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Fixed values of the base rules.
BASE_MIN_WORDS = 50
BASE_REPEAT_PERCENT = 50

#: Ratio, and the least spread that its group is taken to have (ratios that are nearly constant).
RATIOS = {"word_length": 0.25, "symbols_per_word": 0.02, "dup_line_share": 0.1, "repeat_share": 0.06}
#: Spreads outside the upper quartile, or below the lower one for ``word_length``, that are still kept.
FENCE = 6.0
#: Relative error of the quantile digests is 1 over this.
ACCURACY = 10_000
#: Rows from which a group has its own thresholds; smaller ones take those of the language, then of all.
MIN_ROWS = 30


def words_of(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))


def repeated_word_count(words: Column) -> Column:
    """Words inside three-word windows found twice or more in ``words``, first ones included.

    Windows are compared by 64-bit hashes. Linear but for one sort of the
    windows, and nothing is sorted where all windows differ.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            same = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["p"])

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(let(ordered, positions)), start, step, lambda a: a["n"])

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    zero = F.lit(0).cast("long")
    distinct = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h))
    return let(words, lambda w: F.when(F.size(w) < 3, zero).otherwise(let(windows(w), distinct)))


def counts(text: Column) -> dict[str, Column]:
    """The base counts of a text as columns, by name, but for ``n_words`` and ``n_repeat_words``."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    return {
        "word_chars": F.length(F.translate(whole, SPACES, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "line_counts": let(
            lines,
            lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
        ),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id, lang, source``, the base counts and the ratios of every row, written to the shared folder."""
    c = counts(F.col("text"))
    rows = (
        docs.select(
            F.col(id_col).alias("id"),
            F.col(text_col).cast("string").alias("text"),
            F.col(lang_col).cast("string").alias("lang"),
            F.col(source_col).cast("string").alias("source"),
        )
        .withColumn(
            "of_words",
            let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_word_count(w).alias("n_repeat_words"))),
        )
        .select("id", F.xxhash64("text").alias("text_hash"), "lang", "source", "of_words.*", *(v.alias(k) for k, v in c.items()))
        .select("*", "line_counts.*")
        .drop("line_counts")
    )
    per_word = lambda x: F.col(x) / F.greatest(F.col("n_words"), F.lit(1))
    return materialise(
        rows.select(
            "*",
            per_word("word_chars").alias("word_length"),
            per_word("n_symbols").alias("symbols_per_word"),
            (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
            per_word("n_repeat_words").alias("repeat_share"),
            (
                (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
            ).alias("base_failed"),
        ),
        "measured",
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """``level, lang, source, n`` and the quartiles of each ratio; level 0 is a source, 1 a language, 3 all rows.

    Only rows that pass the base rules count, so that junk of one source
    doesn't move its own thresholds. Null languages and sources are groups
    of their own.
    """
    passed = rows.filter(~F.col("base_failed"))
    quartiles = [F.percentile_approx(r, [0.25, 0.5, 0.75], ACCURACY).alias(r) for r in RATIOS]
    by_source = [F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *quartiles]
    sets = passed.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(*by_source)
    return sets.filter(F.col("n") >= MIN_ROWS)


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: the base rules, then the thresholds of the first of source, language and all that has them."""
    limits = materialise(thresholds(rows), "thresholds")
    out = rows
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"]), (3, [])):
        side = limits.filter(F.col("level") == level).select(
            *(F.col(k).alias(f"{k}_{level}") for k in keys), F.struct(*RATIOS).alias(f"limits_{level}")
        )
        if keys:
            match = [F.col(k).eqNullSafe(F.col(f"{k}_{level}")) for k in keys]
            out = out.join(side, match, "left").drop(*(f"{k}_{level}" for k in keys))
        else:  # one row at most
            out = out.join(F.broadcast(side), F.lit(True), "left")
    chosen = F.coalesce("limits_0", "limits_1", "limits_3")
    out = out.withColumn("limits", chosen)
    outside = F.lit(False)
    for ratio, least in RATIOS.items():
        q = F.col("limits")[ratio]
        spread = F.greatest(q[2] - q[0], F.lit(least))
        outside = outside | (F.col(ratio) > q[2] + FENCE * spread)
        if ratio == "word_length":
            outside = outside | (F.col(ratio) < q[0] - FENCE * spread)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).drop("limits", "limits_0", "limits_1", "limits_3")


def quality_verdicts(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` of every row of ``docs``.

    Null and empty texts have no words and fail the base rules. Equal rows
    get equal verdicts and stay repeated. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    return judged(measured(docs, **columns))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with all their columns."""
    verdicts = quality_verdicts(docs, id_col=id_col, text_col=text_col, **columns)
    # equal rows have equal verdicts, so the rows are left where they are and only the rejected are named
    bad = materialise(verdicts.filter("NOT kept").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "rejected")
    marked = docs.withColumn("__h", F.xxhash64(F.col(text_col).cast("string")))
    return marked.join(small_side(bad), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left_anti").drop("__h")
