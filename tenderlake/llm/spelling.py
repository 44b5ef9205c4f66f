"""Spelling variants of words, by asymmetric q-chunks.

Of two words that may differ by one edit, the shorter one (of equal length,
the first in code-point order) contributes two disjoint chunks, its halves;
the other contributes positional grams of these lengths, at the places that
a chunk can have after one edit, which are at most one further on. One edit
leaves one of the two chunks as it is, so an equality join of chunks and
grams finds every pair, and the edit distance verifies it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed value. The characters of a word.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 7
#: Chunks times grams of a key whose pairs are listed; larger keys take the exact way.
LISTED = 1_024
#: A task hands its counts on when it holds so many words.
HELD = 200_000
#: Fixed value. Rounds of doubling in which the longest chain of forms is followed; a form occurs at least ``ratio`` times as often.
ROUNDS = 8


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, drop_every: int | None = None) -> DataFrame:
    """``word, n`` of all words of whole texts with at least ``shortest`` code points.

    A word is a maximal run of letters, of which A-Z are lower-cased. With
    ``drop_every``, runs whose crc32 with the id of their row is divisible by
    it lose one code point first (planted misspellings); rows without an id
    lose none. Null texts have no words. Counts are summed within the tasks.
    """
    find = re.compile(f"[{LETTERS}]{{{shortest},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    words = Counter(find(text.encode("utf-8", "replace").lower().decode()))
                    if drop_every is None or name is None:
                        total.update(words)
                        continue
                    start = zlib.crc32(f"{name}:".encode())
                    for word, n in words.items():
                        mark = zlib.crc32(word.encode(), start)
                        if mark % drop_every == 0:
                            at = mark % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _part(word: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Code points of ``word`` from ``start`` (from 0), to its end if no length is given."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(1 << 30) if length is None else length
    return word.substr(start + 1, F.lit(length) if isinstance(length, int) else length)


def _chunks_and_grams(words: DataFrame) -> DataFrame:
    """Rows ``key, gram, at, size, of, word, n``: the two chunks (``gram`` false) and the positional grams (true) of every word.

    ``of`` is the length of the word that has the chunk; a key holds it, the
    half and the text of chunk or gram.
    """
    word, m = F.col("word"), F.length("word")

    def entry(gram: bool, half: int, of: Column, at: Column, size: Column) -> Column:
        return F.struct(
            F.xxhash64(F.lit(half), of, _part(word, at, size)).alias("key"), F.lit(gram).alias("gram"), at.cast("int").alias("at"), size.cast("int").alias("size"), of.cast("int").alias("of")
        )

    def halves(of: Column) -> tuple[Column, Column]:
        first = F.floor(of / 2).cast("int")
        return first, of - first

    def grams(of: Column, shifts: tuple[int, ...], gram: bool) -> list[Column]:
        first, second = halves(of)
        return [entry(gram, 1, of, F.lit(s), first) for s in shifts] + [entry(gram, 2, of, first + s, second) for s in shifts]

    every = grams(m, (0,), False) + grams(m, (0,), True) + grams(m - 1, (0, 1), True)
    return words.select("word", "n", F.explode(F.array_distinct(F.array(*every))).alias("e")).select("e.*", "word", "n")


def _left_out(keep: Column) -> Column:
    """Hashes of the key and the word with one code point left out, for each place where ``keep(place)`` isn't the chunk's."""
    places = F.filter(F.sequence(F.lit(0), F.length("word") - 1), lambda i: (i < F.col("at")) | (i >= F.col("at") + F.col("size")))
    return F.array_distinct(F.transform(places, lambda i: F.xxhash64("key", F.when(keep, i).otherwise(F.lit(-1)), F.concat(_part(F.col("word"), 0, i), _part(F.col("word"), i + 1)))))


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of distinct words of ``words(word, n)`` that differ by one inserted, deleted or replaced code point, once.

    Keys with at most ``LISTED`` pairs of a chunk and a gram are joined and
    verified pair by pair. Words of larger keys take the exact way: they meet
    by the key and the rest of the word with one code point left out, at the
    same place for a replaced one. Such groups hold true pairs only, so their
    rows grow with the words and not with the square of a key.
    """
    rows = materialise(_chunks_and_grams(words), "chunks")
    sizes = rows.groupBy("key").agg(F.count_if(~F.col("gram")).alias("n_chunks"), F.count_if("gram").alias("n_grams"))
    met = sizes.filter("n_chunks > 0 AND n_grams > 0 AND n_chunks * n_grams > 1").select("key", (F.col("n_chunks") * F.col("n_grams") > LISTED).alias("hot"))
    members = materialise(rows.join(materialise(met, "chunk-keys"), "key"), "chunk-members")

    def sides(of: DataFrame, key: str, *more: str) -> tuple[DataFrame, DataFrame]:
        return (
            of.filter("NOT gram").select(key, F.col("word").alias("a"), F.col("n").alias("a_n"), *more),
            of.filter("gram").select(key, F.col("word").alias("b"), F.col("n").alias("b_n")),
        )

    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    chunks, grams = sides(members.filter("NOT hot"), "key")
    listed = chunks.join(grams, "key").filter(ordered).filter(one_edit).select("a", "a_n", "b", "b_n")

    hot = members.filter("hot")
    replaced = F.length("word") == F.col("of")
    whole = F.when(~F.col("gram"), F.array(F.xxhash64("key", F.lit(-1), "word"))).otherwise(F.array().cast("array<bigint>"))
    variants = hot.select("gram", "word", "n", F.explode(F.concat(_left_out(replaced), whole)).alias("variant"))
    chunks, grams = sides(variants, "variant")
    exact = chunks.join(grams, "variant").filter(ordered).filter(one_edit).select("a", "a_n", "b", "b_n")
    return listed.union(exact).distinct()


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words(word, n)``, whose words are distinct.

    A form is the near word with the largest ``n`` (of equal ones the least in
    code-point order) if that is at least ``ratio`` times the word's own; the
    root is reached by following forms. An empty table gives no rows.
    """
    pairs = materialise(near_words(words), "near-words")
    both = pairs.selectExpr("a AS word", "a_n AS n", "b AS near", "b_n AS near_n").union(pairs.selectExpr("b", "b_n", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"), F.first("n").alias("own"))
    reached = F.when(-F.col("best.less") >= ratio * F.col("own"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    formed = materialise(best.select("word", "n_near", reached.alias("f")).select("word", "n_near", "f.form", "f.form_n"), "forms")
    roots = materialise(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            break
        roots = materialise(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    else:
        raise RuntimeError("forms did not settle")
    return (
        words.join(formed, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, ratio: int = 10, drop_every: int | None = None) -> DataFrame:
    """``variants`` of the words that occur at least ``least`` times in whole texts.

    Repeated rows count again, null and empty texts have no words, and other
    columns of ``docs`` are not read.
    """
    words = materialise(word_counts(docs, id_col, text_col, SHORTEST, drop_every).filter(F.col("n") >= least), "words")
    return variants(words, ratio)
