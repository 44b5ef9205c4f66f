"""Toxicity by the nearest labelled examples, by exact TF-IDF cosine.

The space has every term of the labelled examples; document frequencies come
from all documents, and norms from whole texts. The examples are an inverted
index in blocks, with the largest weight of each term in each block. A query
visits blocks in order of their upper bounds and stops when no other block can
hold a nearer example, so the neighbours are exact. As neighbours share a
subject rather than a tone, the distance that weights their votes stretches
terms that go with the label. Votes are calibrated on the examples themselves,
each one left out of its own vote.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, process_cache

#: Labelled rows in the index, chosen by a hash of their id, and the most bytes of their texts; neighbours that vote, and
#: those of them that are given as evidence; examples in a block.
EXAMPLES = 8_000
EXAMPLE_BYTES = 128 << 20
NEIGHBOURS = 100
EVIDENCE = 15
BLOCK = 64
#: In the distance of a vote, a term that the label decides alone weighs 1 + RELEVANCE times its TF-IDF; a chi-square up to
#: CHANCE counts as none. A vote weighs its cosine there to the power of SHARPNESS, the base rate as one of weight PRIOR.
RELEVANCE = 10.0
CHANCE = 10.0
SHARPNESS = 4
PRIOR = 0.01
#: Terms in more than this share of the examples are kept as columns of a block, all others as postings.
FREQUENT = 1 / 16
#: Cosines are sums of single-precision products and are rounded to six digits; bounds allow for more than their error.
ROUNDING = 2e-6
#: Blocks that a query visits before it knows how near an example has to be, queries in a batch, postings read at a time.
VISIT = 8
QUERIES = 100
POSTINGS = 1 << 18

#: Bytes of ASCII that are no letter or digit separate terms.
SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Lower-cased terms of a text."""
    return text.lower().translate(SEPARATE).split() if text else []


class BlockMaxIndex:
    """Unit vectors of ``n`` examples (``example, term, weight`` of every entry) in blocks, with block maxima.

    Rare terms have postings; frequent ones a column in each block and its
    maximum. Blocks hold examples that are alike in their frequent terms (of
    one language, say), which keeps the maxima low for other queries.
    """

    def __init__(self, n: int, n_terms: int, example: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int = BLOCK):
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        frequent = np.flatnonzero(np.bincount(term, minlength=n_terms) > FREQUENT * n)
        self.column = np.full(n_terms, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        column = self.column[term]
        often = column >= 0
        dense = np.zeros((n, len(frequent)), np.float32)
        dense[example[often], column[often]] = weight[often]
        # one example in each block's worth is a centre; examples are ordered by the centre that they are nearest to
        centres = dense[::block] / np.maximum(np.linalg.norm(dense[::block], axis=1, keepdims=True), 1e-12)
        centre = np.argmax(dense @ centres.T, 1) if n else np.zeros(0, np.int64)
        self.order = np.argsort(centre, kind="stable")
        self.place = np.argsort(self.order).astype(np.int32)
        self.dense = np.zeros((self.blocks, block, len(frequent)), np.float32)
        self.dense.reshape(self.blocks * block, len(frequent))[:n] = dense[self.order]
        self.most = self.dense.max(1)
        rare = np.flatnonzero(~often)[np.argsort(term[~often], kind="stable")]
        self.at, self.weight = self.place[example[rare]], weight[rare].astype(np.float32)
        self.start = np.searchsorted(term[rare], np.arange(n_terms + 1))
        self.visited = self.asked = 0

    def _rare_scores(self, n: int, of: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What postings add to the cosines of ``n`` queries, in parts of bounded size."""
        out = np.zeros((n, self.blocks * self.block))
        size = self.start[terms + 1] - self.start[terms]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(terms):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POSTINGS, "right")))
            part, n_part = slice(lo, hi), size[lo:hi]
            at = np.arange(n_part.sum()) + np.repeat(self.start[terms[part]] - np.cumsum(n_part) + n_part, n_part)
            first, last = of[lo], of[hi - 1]
            cell = np.repeat((of[part] - first) * out.shape[1], n_part) + self.at[at]
            out[first : last + 1] += np.bincount(cell, self.weight[at] * np.repeat(weights[part], n_part), (last - first + 1) * out.shape[1]).reshape(-1, out.shape[1])
            lo = hi
        return out.reshape(n, self.blocks, self.block)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query ``(terms, weights)``, positions and cosines of the ``k`` nearest examples with a cosine above 0.

        Ties go to the lower position. A query first visits the blocks with
        its highest bounds, then those whose bounds reach the cosine of its
        k-th example so far.
        """
        n = len(queries)
        of = np.repeat(np.arange(n), [len(t) for t, _ in queries])
        terms, weights = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        column = self.column[terms]
        often = column >= 0
        full = np.zeros((n, self.dense.shape[2]), np.float32)
        full[of[often], column[often]] = weights[often]
        score = self._rare_scores(n, of[~often], terms[~often], weights[~often])
        for j, i in enumerate(without or ()):
            if i >= 0:
                score[j, self.place[i] // self.block, self.place[i] % self.block] = -np.inf
        bound = score.max(2) + full @ self.most.T
        found = np.full(score.shape, -np.inf)
        first = np.argsort(-bound, 1, kind="stable")[:, :VISIT]
        visit = np.zeros(bound.shape, bool)
        np.put_along_axis(visit, first, True, 1)
        self._visit(visit, score, full, found)
        best = np.take_along_axis(found, first[:, :, None], 1).reshape(n, -1)
        least = np.maximum(np.partition(best, -k, 1)[:, -k], 0.0) if best.shape[1] >= k else np.zeros(n)
        more = (bound >= least[:, None] - ROUNDING) & (bound > 0) & ~visit
        self._visit(more, score, full, found)
        self.asked += bound.size
        self.visited += int(visit.sum() + more.sum())
        out = []
        for j in range(n):
            at = np.flatnonzero((found[j].ravel() >= least[j] - ROUNDING) & (found[j].ravel() > ROUNDING))
            i, s = self.order[at], np.round(found[j].ravel()[at], 6)
            top = np.lexsort((i, -s))[:k]
            out.append((i[top], s[top]))
        return out

    def _visit(self, which: np.ndarray, score: np.ndarray, full: np.ndarray, found: np.ndarray) -> None:
        for b in np.flatnonzero(which.any(0)):
            q = np.flatnonzero(which[:, b])
            found[q, b] = score[q, b] + full[q] @ self.dense[b].T


def unit_vector(terms: np.ndarray, tf: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights (1 + log tf) * scale of length 1."""
    w = (1 + np.log(tf)) * scale[terms]
    return w / np.sqrt((w * w).sum()) if len(w) else w


class Stretched:
    """Unit vectors of the examples (entries in the order of examples) with their terms stretched.

    Few terms are stretched, so that a product there is the plain one and what these few terms add to it.
    """

    def __init__(self, n: int, example: np.ndarray, term: np.ndarray, weight: np.ndarray, stretch: np.ndarray):
        self.stretch, self.more = stretch, stretch * stretch - 1
        self.norm = np.sqrt(np.bincount(example, (weight * stretch[term]) ** 2, n))
        some = np.flatnonzero(stretch[term] != 1)
        self.all, self.few = ((np.searchsorted(e, np.arange(n + 1)), t, w) for e, t, w in ((example, term, weight), (example[some], term[some], weight[some])))
        self.query = np.zeros(len(stretch))

    def _products(self, entries: tuple[np.ndarray, np.ndarray, np.ndarray], terms: np.ndarray, weights: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """Of the query ``terms, weights`` with the entries (start, term and weight) of each of ``examples``."""
        start, term, weight = entries
        self.query[terms] = weights
        size = start[examples + 1] - start[examples]
        at = np.arange(size.sum()) + np.repeat(start[examples] - np.cumsum(size) + size, size)
        found = np.bincount(np.repeat(np.arange(len(examples)), size), weight[at] * self.query[term[at]], len(examples))
        self.query[terms] = 0
        return found

    def cosines(self, terms: np.ndarray, weights: np.ndarray, examples: np.ndarray, plain: np.ndarray | None = None) -> np.ndarray:
        """Of the query ``terms, weights``, which aren't stretched yet, with each of ``examples``; ``plain`` are the cosines without stretching, if known."""
        if plain is None:
            plain = self._products(self.all, terms, weights, examples)
        stretched = weights * self.stretch[terms]
        found = plain + self._products(self.few, terms, weights * self.more[terms], examples)
        return np.minimum(found / (np.sqrt(stretched @ stretched) * self.norm[examples]), 1)


def vote(labels: np.ndarray, cosines: np.ndarray, base: float) -> float:
    """Share of the label among the neighbours, each weighted by its nearness, and the base rate."""
    weights = cosines**SHARPNESS
    return float((weights @ labels + PRIOR * base) / (weights.sum() + PRIOR))


def calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising step curve from vote to rate, by pooling adjacent violators, with one case of each label added to a step."""
    cuts = np.unique(votes)
    n = np.array([(votes == c).sum() for c in cuts], float)
    hits = np.array([labels[votes == c].sum() for c in cuts], float)
    pools: list[list[float]] = []
    for c, m, h in zip(cuts, n, hits, strict=True):
        pools.append([c, m, h])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            _, m2, h2 = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + m2, pools[-1][2] + h2]
    return np.array([p[0] for p in pools]), np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])


def term_hashes(text: bytes | None) -> np.ndarray:
    """A hash of 64 bits for each term of a text; terms are told apart by these alone."""
    terms = terms_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)).view(np.int64)


def _count_terms(texts: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """``term, n, ones``: texts of ``texts(mark, text)`` that hold each (known) term, and those with a mark among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                got = [np.unique(term_hashes(t)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                terms, n = np.unique(np.concatenate(got), return_counts=True)
                ones, marks = np.zeros(len(n), np.int64), part.column(0).to_pylist()
                for mark in set(marks) - {0}:
                    held, n_held = np.unique(np.concatenate([x for x, m in zip(got, marks, strict=True) if m == mark]), return_counts=True)
                    ones[np.searchsorted(terms, held)] += mark * n_held
                if known is not None:
                    some = _ids(terms, known.value)[0]
                    terms, n, ones = terms[some], n[some], ones[some]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (terms, n, ones)], ["term", "n", "ones"])

    return texts.mapInArrow(run, "term long, n long, ones long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


def _ids(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are known, and their places in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    some = known[at] == hashes
    return some, at[some]


def _bag(text: bytes | None, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the known terms of a text, by id."""
    hashes, n = np.unique(term_hashes(text), return_counts=True)  # in order, as the known ones are, which keeps the search local
    some, ids = _ids(hashes, known)
    return ids, n[some]


def relevance(n: np.ndarray, ones: np.ndarray, n_examples: int, n_ones: float) -> np.ndarray:
    """By how much terms are stretched: 1 and more with the correlation of a term and the label beyond chance."""
    spread = n * (n_examples - n) * n_ones * (n_examples - n_ones)
    chi = n_examples * (ones * n_examples - n * n_ones) ** 2 / np.where(spread > 0, spread, np.inf)
    return 1 + RELEVANCE * np.sqrt(np.maximum(chi - CHANCE, 0) / n_examples)


def score(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    examples: int = EXAMPLES,
    k: int = NEIGHBOURS,
    evidence: int = EVIDENCE,
    example_bytes: int = EXAMPLE_BYTES,
) -> DataFrame:
    """``id, held_out, score, neighbours, cosines`` of every row of ``docs``.

    ``held_out`` is a condition on ``id``; rows that meet it are no examples.
    At most ``examples`` labelled rows are, taken in the order of a hash of
    their id up to ``example_bytes`` of text. The ``k`` nearest of them vote.
    ``neighbours`` are ids of the nearest ``evidence`` of those, and ``cosines`` theirs. A text
    without a term of the examples, as null and empty ones, has no neighbours and gets the rate of such
    examples. Of an id with several labels or texts the highest label and
    the least text count. Without examples every score is 0. Repeated rows
    stay repeated; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    chosen = known.filter(~held_out).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(examples)
    # at most ``examples`` rows of two numbers are broadcast
    with_text = materialise(rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "examples")
    # the order is of at most ``examples`` rows, without their texts
    length = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64(F.col("id").cast("string")), "id"))
    within = with_text.select("id", length.alias("so_far")).filter(F.col("so_far") <= example_bytes).select("id")
    with_text = with_text.join(F.broadcast(within), "id")
    n_ones, n_examples = with_text.agg(F.sum("label"), F.count("*")).first()
    context = docs.sparkSession.sparkContext
    held = _count_terms(with_text.select("label", "text")).orderBy("term").toArrow()
    # arrays are sent, not objects of this package, which workers may not have
    terms = context.broadcast(held["term"].to_numpy())
    often = _count_terms(rows.select(F.lit(0), "text"), terms).orderBy("term").toArrow()["n"].to_numpy()
    stretch = relevance(held["n"].to_numpy().astype(float), held["ones"].to_numpy().astype(float), n_examples, n_ones or 0)
    scale = np.log((1 + rows.count()) / (1 + often)) + 1

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_bag(text, terms.value) for text in batch.column(2).cast(pa.binary()).to_pylist()]
            cells = [pa.array([x[i] for x in got], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], ["id", "label", "terms", "tf"])

    kind = rows.schema["id"].dataType.simpleString()
    # at most ``examples`` rows reach the driver
    table = with_text.select("id", "label", "text").mapInArrow(bags, f"id {kind}, label int, terms array<int>, tf array<int>").orderBy("id").toArrow()
    ids, y = table["id"].to_pylist(), table["label"].to_numpy().astype(float)
    bag_terms, bag_tf = (table[c].combine_chunks().flatten().to_numpy() for c in ("terms", "tf"))
    size = pc.list_value_length(table["terms"]).to_numpy()
    weight = (1 + np.log(bag_tf)) * scale[bag_terms]
    of = np.repeat(np.arange(len(ids), dtype=np.int32), size)
    weight /= np.sqrt(np.bincount(of, weight * weight, len(ids)))[of]
    base = float(y.mean()) if ids else 0.0
    share = context.broadcast((scale, stretch, y, ids, base, of, bag_terms, weight.astype(np.float32)))
    key = uuid4().hex

    def votes(of_examples: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scale, stretch, y, ids, base, *entries = share.value
            built = process_cache("toxicity-index", dict)  # one index a worker, across its tasks
            if key not in built:
                built.clear()
                built[key] = BlockMaxIndex(len(ids), len(scale), *entries), Stretched(len(ids), *entries, stretch), {i: j for j, i in enumerate(ids)}
            index, near_label, place = built[key]
            for batch in batches:
                for a in range(0, batch.num_rows, QUERIES):
                    part = batch.slice(a, QUERIES)
                    bags = [_bag(text, terms.value) for text in part.column(2).cast(pa.binary()).to_pylist()]
                    own = [place.get(i, -1) for i in part.column(0).to_pylist()] if of_examples else None
                    asked = [(t, unit_vector(t, tf, scale)) for t, tf in bags]
                    got = index.nearest(asked, k, own)
                    kind = part.column(0).type
                    near = pa.array([[ids[x] for x in i[:evidence]] for i, _ in got], pa.list_(kind))
                    cast = pa.array([vote(y[i], near_label.cosines(*q, i, s), base) if len(i) else None for q, (i, s) in zip(asked, got, strict=True)], pa.float64())
                    cosine = pa.array([s[:evidence] for _, s in got], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cast, near, cosine], ["id", "mark", "vote", "neighbours", "cosines"])

        return run

    schema = f"id {kind}, mark boolean, vote double, neighbours array<{kind}>, cosines array<double>"
    cases = with_text.repartition("id").select("id", (F.col("label") == 1).alias("mark"), "text").mapInArrow(votes(True), schema).select("mark", "vote").toPandas()
    some = cases["vote"].notna().to_numpy()
    marks, cast = cases["mark"].to_numpy(float), cases["vote"].to_numpy(float)
    cuts, rates = calibrate(cast[some], marks[some]) if some.any() else (np.zeros(1), np.array([base]))
    silent = float((marks[~some].sum() + 0.5 * base) / ((~some).sum() + 0.5)) if (~some).any() else base

    # the last step of the curve that a vote reaches
    step = F.size(F.filter(F.lit(cuts.tolist()), lambda c: c <= F.col("vote")))
    calibrated = F.when(F.col("vote").isNull(), silent).otherwise(F.element_at(F.lit(rates.tolist()), F.greatest(step, F.lit(1))))
    found = rows.select("id", held_out.alias("held_out"), "text").mapInArrow(votes(False), schema)
    return found.select("id", F.col("mark").alias("held_out"), calibrated.alias("score"), "neighbours", "cosines")
