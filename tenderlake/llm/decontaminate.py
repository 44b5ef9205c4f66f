"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every window of ten benchmark words is indexed by the least of its k-gram
hashes. A document keeps the hashes that are least in some sliding window of
as many k-grams, which include the one that any shared window is indexed by;
an equality join therefore meets every shared window, and each meeting is
extended to the whole window and verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, let, materialise, small_side

#: Characters of a word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a benchmark window, and in the k-grams that are hashed.
WINDOW = 10
GRAM = 5
#: The index is broadcast only up to so many windows (about 200 bytes each); a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased words; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def grams(words: Column, k: int) -> Column:
    """Hash of the k-gram at each position."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def winnowed(words: Column, window: int, k: int) -> Column:
    """``struct(h, p)`` of the k-grams whose hash is least in some window of ``window`` words.

    Ties are all kept. A text shorter than the window has none.
    """
    span = window - k + 1

    def picked(h: Column) -> Column:
        every = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        if span == 1:
            return every
        least = F.transform(F.sequence(F.lit(1), F.size(h) - span + 1), lambda i: F.array_min(F.slice(h, i, span)))

        def chosen(m: Column) -> Column:
            # the windows that hold position p start at p - span + 1 .. p
            top = lambda i: F.array_max(F.slice(m, F.greatest(i - (span - 2), F.lit(1)), F.least(i + 1, F.lit(span))))
            return F.filter(every, lambda x, i: top(i) == x["h"])

        return let(least, chosen)

    none = F.array().cast("array<struct<h:bigint,p:int>>")
    return F.when(F.size(words) >= window, let(grams(words, k), picked)).otherwise(none)


def all_windows(words: Column, n: int) -> Column:
    """``struct(h, p, len)`` of every run of ``n`` words."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    hashed = lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))
    found = F.transform(at, lambda i: F.struct(hashed(i).alias("h"), (i - 1).alias("p"), F.lit(n).alias("len")))
    return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<struct<h:bigint,p:int,len:int>>"))


def window_index(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``item, len, w, h, o``: each window of each item once, its words, the least k-gram hash and that k-gram's first offset.

    Items with fewer words are one window of their own length, indexed by the
    hash of all its words. Items without words have no window.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(1), F.size("words") - window + 1)
    full = rows.filter(F.size("words") >= window).select(
        "item", F.lit(window).alias("len"), F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("w")
    )
    short = rows.filter((F.size("words") > 0) & (F.size("words") < window)).select(
        "item", F.size("words").alias("len"), F.col("words").alias("w"), F.expr("xxhash64(array_join(words, ' '))").alias("h"), F.lit(0).alias("o")
    )
    full = full.distinct().withColumn("g", grams(F.col("w"), k)).select("item", "len", "w", F.array_min("g").alias("h"), F.expr("cast(array_position(g, array_min(g)) AS int) - 1").alias("o"))
    return full.union(short.distinct())


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = GRAM,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Per row of ``docs``: ``id, text_hash, n_words, n_hit, n_items, items, spans``.

    ``n_hit`` counts the words inside a window that the benchmark has,
    ``spans`` lists them as maximal ``struct(start, end)`` (end excluded),
    ``items`` the item ids, as sorted strings. Null and empty texts have no
    words and no hit; rows that repeat an id with another text are counted
    apart, equal rows as one. Items may repeat. An empty benchmark gives no
    hit, an empty table an empty result. Other columns are not read.
    """
    windows = materialise(window_index(items, item_col, item_text_col, window, k), "item-windows")
    index = materialise(windows.select("len", "w", "h", "o").distinct().withColumn("win", F.xxhash64("w")), "window-index")
    short = sorted(r["len"] for r in index.filter(F.col("len") < window).select("len").distinct().collect())  # below ten values
    small = index.count() <= broadcast_windows

    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        "id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")
    )
    tag = lambda marks, n: F.transform(marks, lambda x: F.struct(x["h"].alias("h"), x["p"].alias("p"), F.lit(n).alias("len")))
    # a mark of length 0 carries the number of words; its hash spreads these marks over the partitions and meets no window
    size_row = F.array(F.struct(F.coalesce("text_hash", F.lit(0)).alias("h"), F.size("words").alias("p"), F.lit(0).alias("len")))
    shorter = [all_windows(F.col("words"), n) for n in short]
    marks = F.concat(size_row, tag(winnowed(F.col("words"), window, k), window), *shorter)
    exploded = words.select("id", "text_hash", "words", F.explode(marks).alias("m"))
    # words around a k-gram, enough for any window that holds it
    back = F.least(F.col("m.p"), F.lit(window - k))
    around = F.slice("words", F.col("m.p") - back + 1, 2 * window - k)
    seeds = exploded.select(
        "id", "text_hash", F.col("m.h").alias("h"), F.col("m.p").alias("p"), F.col("m.len").alias("len"),
        F.when(F.col("m.len") > 0, around).alias("around"), back.alias("back"),
    )
    side = index.withColumnRenamed("h", "wh").withColumnRenamed("len", "wlen")
    joined = seeds.join(F.broadcast(side) if small else side, (F.col("h") == F.col("wh")) & (F.col("len") == F.col("wlen")), "left")
    start = F.col("back") - F.col("o")
    same = (start >= 0) & F.coalesce(F.slice("around", start + 1, F.col("wlen")) == F.col("w"), F.lit(False))
    hits = joined.filter((F.col("len") == 0) | (F.col("wh").isNotNull() & same)).select(
        "id", "text_hash",
        F.when(F.col("len") == 0, F.col("p")).alias("n_words"),
        F.when(F.col("len") > 0, F.struct((F.col("p") - F.col("o")).alias("s"), (F.col("p") - F.col("o") + F.col("wlen")).alias("e"))).alias("span"),
        "win",
    )
    per_doc = materialise(
        hits.groupBy("id", "text_hash").agg(
            F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_set("span")).alias("hit"), F.collect_set("win").alias("wins")
        ),
        "doc-hits",
    )
    # hit words in order; a span opens where the word before isn't hit, and closes where the next isn't
    hit_words = F.sort_array(F.array_distinct(F.flatten(F.transform("hit", lambda x: F.sequence(x["s"], x["e"] - 1)))))
    opened = lambda h: F.filter(h, lambda p, i: F.coalesce(F.get(h, i - 1) < p - 1, F.lit(True)))
    closed = lambda h: F.filter(h, lambda p, i: F.coalesce(F.get(h, i + 1) > p + 1, F.lit(True)))
    spans = let(hit_words, lambda h: F.zip_with(opened(h), closed(h), lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"))))
    of_items = (
        per_doc.filter(F.size("wins") > 0)
        .select("id", "text_hash", F.explode("wins").alias("win"))
        .join(windows.select("item", F.xxhash64("w").alias("win")).distinct(), "win")
        .groupBy("id", "text_hash")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    found = per_doc.withColumn("spans", spans).alias("d").join(
        of_items.alias("i"), F.col("d.id").eqNullSafe(F.col("i.id")) & F.col("d.text_hash").eqNullSafe(F.col("i.text_hash")), "left"
    )
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        F.col("d.id").alias("id"), F.col("d.text_hash").alias("text_hash"), "n_words", covered.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), "spans",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    bad = materialise(
        overlaps(docs, items, id_col, text_col, **how).filter("n_hit > 0").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")), "contaminated"
    )
    marked = docs.withColumn("__h", F.xxhash64(F.col(text_col).cast("string")))
    return marked.join(small_side(bad), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left_anti").drop("__h")
