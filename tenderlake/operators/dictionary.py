"""Terms of a large dictionary in texts, by an equality join of word n-grams.

A text's words are cut out once; its n-grams, in the lengths that the
dictionary has, meet the dictionary in one join. So the work grows with the
texts and hardly with the number of terms, and no pattern is compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. What stands between phrases, and between the words of one.
BREAKS = r"[^a-z0-9_\s]+"
BLANKS = r"\s+"
#: Terms whose table is broadcast (about 100 bytes each); larger dictionaries are joined by a shuffle.
BROADCAST_TERMS = 500_000


def phrases(text: Column) -> Column:
    """The words of a text, lower-cased, as arrays: one for each run of words with nothing but white space between them."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS)
    return F.filter(F.transform(runs, lambda r: F.filter(F.split(r, BLANKS), lambda w: w != "")), lambda ws: F.size(ws) > 0)


def ngrams(words: Column, sizes: list[int]) -> Column:
    """The distinct n-grams of phrases, in the given sizes, words joined by one space."""

    def of(ws: Column, n: int) -> Column:
        if n == 1:
            return ws
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))

    # a lambda is called as it is given, so it sees its own n
    every = [F.flatten(F.transform(words, lambda ws: of(ws, n))) for n in sizes]
    return F.array_distinct(F.concat(*every))


def dictionary(terms: DataFrame, term: str, order: str) -> DataFrame:
    """``gram, size, term, place``: each term as the n-grams that mean it, itself and its plural with ``s``.

    Terms are words with white space between them; ``order`` gives their place
    in results. Repeated terms keep the first place. A term with anything but
    letters, digits, underscores and white space, or without a word, is an
    error, since no n-gram could ever meet it.
    """
    gram = F.array_join(F.filter(F.split(F.lower(term), BLANKS), lambda w: w != ""), " ")
    checked = F.when(gram.rlike("^[a-z0-9_]+( [a-z0-9_]+)*$"), gram).otherwise(F.raise_error(F.concat(F.lit("not words: "), F.coalesce(F.col(term), F.lit("null")))))
    rows = terms.select(checked.alias("gram"), F.col(term).alias("term"), F.col(order).alias("place")).groupBy("gram").agg(F.min_by("term", "place").alias("term"), F.min("place").alias("place"))
    size = F.size(F.split("gram", " "))
    return rows.select(F.explode(F.array("gram", F.concat("gram", F.lit("s")))).alias("gram"), size.alias("size"), "term", "place")


def dictionary_matches(df: DataFrame, key: str, text_col: str, entries: DataFrame) -> DataFrame:
    """``key, term, place`` of each term of ``entries`` (from ``dictionary``) that occurs in a text, once or, with its plural, twice.

    The entries
    are broadcast if there are at most ``BROADCAST_TERMS``, by a count.
    """
    found = entries.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    if not found["n"]:
        return df.select(key, F.lit(None).cast(entries.schema["term"].dataType).alias("term"), F.lit(None).cast(entries.schema["place"].dataType).alias("place")).limit(0)
    grams = df.select(key, phrases(F.col(text_col)).alias("__words")).select(key, F.explode(ngrams(F.col("__words"), found["sizes"])).alias("__gram"))
    side = F.broadcast(entries) if found["n"] <= BROADCAST_TERMS else entries
    return grams.join(side, F.col("__gram") == F.col("gram")).select(key, "term", "place")


def dictionary_terms(df: DataFrame, key: str, text_col: str, entries: DataFrame) -> DataFrame:
    """``key, terms`` for every key of ``df``: the terms that occur, in dictionary order; an empty array where there are none.

    A text that repeats a key counts as more of the same text.
    """
    hits = dictionary_matches(df, key, text_col, entries)
    listed = hits.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_set(F.struct("place", "term"))).alias("__found"))
    terms = F.coalesce(F.transform("__found", lambda x: x["term"]), F.array().cast("array<string>"))
    return df.select(key).distinct().join(listed, F.col(key).eqNullSafe(F.col("__k")), "left").select(key, terms.alias("terms"))
