"""Language-model scores of documents by masked pseudo-likelihood.

A small network sees the words on both sides of a place, but not the word
itself, and predicts it. The most frequent words have an id each and all
others share ids by hash. Ids are grouped into classes; the network gives the
class, then the id within its class, and counts over the corpus give the word
among those that share an id: a word that is listed has its own share of the
occurrences, and the words that aren't divide what is left. The list grows
with the square root of the number of words in the corpus. The network is trained in numpy on every word of every document: documents are
dealt into shards by hash, a copy of the network is trained on each shard, and
the copies are averaged, so the result doesn't depend on how the table is
partitioned. A document's score is the sum of the log probabilities of all of
its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Ids, a square number, so that there are as many classes as ids in a class; half of them are for frequent words, half for hashes.
VOCABULARY = 4_096
#: Words that have a share of their own are at most LISTED times the root of the number of words in the corpus, taken by
#: frequency, in steps of a STEPS-th of a doubling.
LISTED = 4
STEPS = 8
#: Numbers to an id, words seen on either side.
WIDTH = 16
SIDE = 2
#: Rounds of training over all words, documents in a shard (on average); up to SHARD_PARTITIONS every shard is a task of its
#: own, beyond that a task has as many shards as this needs, and at most TASK_SHARDS.
ROUNDS = 1
SHARD_DOCUMENTS = 2_000
SHARD_PARTITIONS = 2_000
TASK_SHARDS = 64
RATE = 40.0
BATCH = 8_192
#: Most that a step changes a weight; it holds where few ids share all of a batch.
MOVE = 0.1
#: Exponents up to this are taken as they are.
EXPONENT = 60.0
#: Documents whose words a task holds at a time.
DOCUMENTS = 200
#: Parameters in a row of the averaging shuffle.
CHUNK = 4_096

SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().translate(SEPARATE).split() if text else []


class WordIds(dict):
    """Ids of the frequent words; other words get one of ``buckets`` ids after them by hash."""

    def __init__(self, known: dict[bytes, int], own: int, buckets: int):
        super().__init__(known)
        self.own, self.buckets = own, buckets

    def __missing__(self, word: bytes) -> int:
        return self.own + xxhash.xxh64_intdigest(word) % self.buckets


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``word, bucket, n`` over all documents; each task adds up its own first, in bounded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            bucket = pa.array([xxhash.xxh64_intdigest(w) % buckets for w in held], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), bucket, pa.array(list(held.values()), pa.int64())], ["word", "bucket", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                held.update(words_of(text.as_py()))
                if len(held) > 300_000:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("n"))


def word_shares(counts: DataFrame, top: list[bytes], buckets: int, listed: int = LISTED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and log shares of the listed words among those of their bucket, by hash, and the log share of a word that isn't listed, by bucket.

    ``counts`` are those of ``word_counts`` and ``top`` the words with an id of their own, which have none here.
    """
    spark = counts.sparkSession
    rest = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in top], "word binary")), "word", "left_anti")
    step = F.floor(F.log2("n") * STEPS).cast("int")
    steps = rest.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()  # at most 64 * STEPS rows
    most, least = listed * isqrt(sum(r["n"] for r in steps)), None
    for r in steps:
        most -= r["words"]
        if most < 0:
            break
        least = r["step"]
    # sublinear in the corpus: at most ``most`` rows of a hash, a bucket and a count
    some = rest.filter(step >= least if least is not None else F.lit(False)).select(F.col("word"), "bucket", "n").toArrow()
    hashes = np.array([xxhash.xxh64_intdigest(w.as_py()) for w in some["word"]], np.uint64)
    bucket, n = some["bucket"].to_numpy().astype(np.int64), some["n"].to_numpy().astype(float)
    total, words = np.zeros(buckets), np.zeros(buckets)
    for r in rest.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # at most ``buckets`` rows
        total[r["bucket"]], words[r["bucket"]] = r["n"], r["words"]
    left, unlisted = total - np.bincount(bucket, n, buckets), words - np.bincount(bucket, minlength=buckets)
    with np.errstate(divide="ignore"):
        other = np.log(np.where(unlisted > 0, left / np.maximum(unlisted * total, 1), 1.0))
    order = np.argsort(hashes)
    return hashes[order], np.log(n / total[bucket])[order].astype(np.float32), other.astype(np.float32)


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> tuple[dict[bytes, int], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of the most frequent words, most frequent first, the counts of all ids (words, then hashes of all others) and the shares of these."""
    own = size // 2
    counts = materialise(word_counts(docs, size - own), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(own).collect()
    n = np.zeros(size)
    n[: len(top)] = [r["n"] for r in top]
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        n[own + r["bucket"]] = r["n"]
    for r in top:
        n[own + r["bucket"]] -= r["n"]
    known = {bytes(r["word"]): i for i, r in enumerate(top)}
    return known, n, word_shares(counts, list(known), size - own)


def _settled(z: np.ndarray) -> np.ndarray:
    """``z`` itself where no exponential of it can leave single precision, else shifted by the largest value of each row."""
    if z.size and (z.max() > EXPONENT or z.min() < -EXPONENT):
        z -= z.max(1, keepdims=True)
    return z


def _totals(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


class MaskedModel:
    """Weights as views of one flat array. Padding beyond an end of a text has the id ``size``."""

    def __init__(self, counts: np.ndarray, width: int = WIDTH, side: int = SIDE, seed: int = 0):
        classes = isqrt(len(counts))
        self.size, self.classes, self.width, self.side = len(counts), classes, width, side
        self.members = self.size // classes
        # frequent words are dealt over the classes, so that no class is much likelier than another
        order = np.argsort(-counts, kind="stable")
        self.class_of, self.member_of = np.empty(self.size, np.int64), np.empty(self.size, np.int64)
        self.class_of[order], self.member_of[order] = np.arange(self.size) % classes, np.arange(self.size) // classes
        shapes = [(2 * side, self.size + 1, width), (width,), (width, classes), (classes,), (classes, width, self.members), (classes, self.members)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        self.flat = np.zeros(ends[-1], np.float32)
        parts = [self.flat[b - int(np.prod(s)) : b].reshape(s) for s, b in zip(shapes, ends, strict=True)]
        self.context, self.bias, self.to_class, self.class_bias, self.to_member, self.member_bias = parts
        r = np.random.default_rng(seed)
        for w in (self.context, self.to_class, self.to_member):
            w[...] = r.normal(0, 0.1, w.shape)
        # biases start at the unigram model
        share = (counts + 0.5) / (counts + 0.5).sum()
        per_class = np.bincount(self.class_of, weights=share, minlength=classes)
        self.class_bias[...] = np.log(per_class)
        self.member_bias[self.class_of, self.member_of] = np.log(share / per_class[self.class_of])

    def windows(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ids on both sides of the places ``at`` of ``padded``."""
        return np.stack([padded[at + d] for d in range(-self.side, self.side + 1) if d])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.repeat(self.bias[None], around.shape[1], 0)
        for j, ids in enumerate(around):
            h += np.take(self.context[j], ids, axis=0)
        return np.tanh(h)

    def _by_class(self, around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The places in order of the class of their word, their hidden values and classes, and ``class, begin, end``."""
        c = self.class_of[target]
        order = np.argsort(c.astype(np.uint16 if self.classes <= 1 << 16 else np.int64), kind="stable")  # short integers are sorted by radix
        begin = np.searchsorted(c[order], np.arange(self.classes + 1)).tolist()
        return order, self.hidden(around[:, order]), c[order], [(k, a, b) for k, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)) if a < b]

    def _members(self, h: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
        """What each place in order of classes gives the ids within its class, before normalising."""
        z = np.empty((len(h), self.members), np.float32)
        for k, a, b in groups:
            np.matmul(h[a:b], self.to_member[k], out=z[a:b])
            z[a:b] += self.member_bias[k]
        return z

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target id given the words around it."""
        order, h, c, groups = self._by_class(around, target)
        member = self.member_of[target[order]]
        found = np.zeros(len(c), np.float32)
        for z, which in ((h @ self.to_class + self.class_bias, c), (self._members(h, groups), member)):
            z = _settled(z)
            found += z[np.arange(len(c)), which]
            np.exp(z, out=z)
            found -= np.log(_totals(z))
        out = np.empty(len(target))
        out[order] = found
        return out

    def step(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean loss of a batch; no weight moves by more than MOVE."""
        order, h, c, groups = self._by_class(around, target)
        member, scale = self.member_of[target[order]], np.float32(rate / len(c))

        def move(weights: np.ndarray, change: np.ndarray) -> None:
            weights -= np.minimum(np.maximum(change, -MOVE), MOVE)

        def error(z: np.ndarray, which: np.ndarray) -> np.ndarray:
            z = _settled(z)
            np.exp(z, out=z)
            z /= _totals(z)[:, None]
            z[np.arange(len(z)), which] -= 1
            return z

        e = error(h @ self.to_class + self.class_bias, c)
        back = e @ self.to_class.T
        e *= scale
        move(self.to_class, h.T @ e)
        move(self.class_bias, e.sum(0))
        e = error(self._members(h, groups), member)
        to_member, member_bias = np.zeros_like(self.to_member), np.zeros_like(self.member_bias)
        for k, a, b in groups:
            back[a:b] += e[a:b] @ self.to_member[k].T
            np.matmul(h[a:b].T, e[a:b], out=to_member[k])
            e[a:b].sum(0, out=member_bias[k])
        move(self.to_member, to_member * scale)
        move(self.member_bias, member_bias * scale)
        back *= scale * (1 - h * h)
        move(self.bias, back.sum(0))
        columns = back.T.astype(float)
        for j, ids in enumerate(around):
            at = ids[order]
            change = np.array([np.bincount(at, x, self.size + 1) for x in columns])
            move(self.context[j], change.T.astype(np.float32, order="C"))


def _hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)


def _log_shares(words: list[bytes] | np.ndarray, shares: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log share of each of ``words`` (or their hashes), which have no id of their own, among the words of its id."""
    listed, log_share, other = shares
    hashes = words if isinstance(words, np.ndarray) else _hashes(words, len(words))
    found = other[(hashes % np.uint64(len(other))).astype(np.int64)].astype(float)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
        found = np.where(listed[at] == hashes, log_share[at], found)
    return found


def _padded(texts: list[bytes | None], known: WordIds, size: int, side: int, spelled: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with padding between them, the places of words, and the text of each; hashes of words without an id of their own go to ``spelled``."""
    ids, at, of, end = [np.full(side, size)], [], [], side
    for j, text in enumerate(texts):
        words = words_of(text)
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        other = np.flatnonzero(found < 0)
        hashes = _hashes(map(words.__getitem__, other.tolist()), len(other))
        found[other] = known.own + (hashes % np.uint64(known.buckets)).astype(np.int64)
        if spelled is not None:
            spelled.append(hashes)
        ids += [found, np.full(side, size)]
        at.append(np.arange(end, end + len(words)))
        of.append(np.full(len(words), j))
        end += len(words) + side
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(ids), np.concatenate(at or empty), np.concatenate(of or empty)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        for a in range(0, batch.num_rows, DOCUMENTS):
            part = batch.slice(a, DOCUMENTS)
            yield part, part.column(column).cast(pa.binary()).to_pylist()


def _summed(chunks: DataFrame) -> tuple[np.ndarray, int]:
    """The sums by chunk of ``chunk, seen, values``, put together, and of ``seen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        seen: Counter = Counter()
        for batch in batches:
            for chunk, n, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                seen[chunk] += n
                values = values.values.to_numpy()
                sums[chunk] = sums[chunk] + values if chunk in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([seen[c] for c in sums], pa.int64()), pa.array(sums.values(), pa.list_(pa.float64()))], names)

    names = ["chunk", "seen", "values"]
    got = sorted(chunks.repartition("chunk").mapInArrow(run, "chunk int, seen long, values array<double>").collect())  # one model's parameters
    return np.concatenate([r["values"] for r in got] or [np.zeros(0)]), got[0]["seen"] if got else 0


def train(docs: DataFrame, rounds: int = ROUNDS, size: int = VOCABULARY, shard_documents: int = SHARD_DOCUMENTS, rate: float = RATE) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Known words, counts of ids, weights and shares of words, from all of ``docs(id, text)``.

    A round trains a copy on each shard, on every word of its documents in the
    order of a hash, and averages the copies by their words. Tasks send the
    sum of their own copies, and the driver gets the sum of all.
    """
    known, counts, shares = vocabulary(docs, size)
    flat = MaskedModel(counts).flat
    context = docs.sparkSession.sparkContext
    shards = max(1, -(-docs.count() // shard_documents))
    rank = F.xxhash64("id", "text")
    dealt = docs.select(F.pmod(rank, F.lit(shards)).cast("int").alias("shard"), rank.alias("rank"), "text")
    parts = max(min(shards, SHARD_PARTITIONS), -(-shards // TASK_SHARDS))
    for n in range(rounds):
        sent = context.broadcast((known, counts, flat))

        def run(batches: Iterator[pa.RecordBatch], n: int = n, sent=sent) -> Iterator[pa.RecordBatch]:
            known, counts, flat = sent.value
            own, words, total, all_seen = MaskedModel(counts), WordIds(known, len(counts) // 2, len(counts) - len(counts) // 2), 0.0, 0
            now, seen = None, 0
            rows = ((shard, text) for batch in batches for shard, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True))
            ahead = next(rows, None)
            while ahead is not None:
                # up to DOCUMENTS rows of one shard, however Spark cuts its batches
                shard, texts = ahead[0], [ahead[1]]
                ahead = None
                for row in rows:
                    if row[0] != shard or len(texts) == DOCUMENTS:
                        ahead = row
                        break
                    texts.append(row[1])
                if shard != now:
                    total, all_seen = total + seen * own.flat.astype(np.float64), all_seen + seen
                    own.flat[:], now, seen = flat, shard, 0
                    r = np.random.default_rng((n, shard))
                ids, at, _ = _padded(texts, words, own.size, own.side)
                r.shuffle(at)
                for a in range(0, len(at), BATCH):
                    p = at[a : a + BATCH]
                    own.step(own.windows(ids, p), ids[p], rate * len(p) / BATCH)
                seen += len(at)
            total, all_seen = total + seen * own.flat.astype(np.float64), all_seen + seen
            if all_seen:
                values = [total[a : a + CHUNK] for a in range(0, len(total), CHUNK)]
                columns = [pa.array(range(len(values)), pa.int32()), pa.array([all_seen] * len(values), pa.int64()), pa.array(values, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "seen", "values"])

        ordered = dealt.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "rank")
        total, seen = _summed(materialise(ordered.mapInArrow(run, "chunk int, seen long, values array<double>"), "model-sums"))
        if seen:
            flat = (total / seen).astype(np.float32)
    return known, counts, flat, shares


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``id, n_words, hashed_words, log_probability, mean_log_probability, perplexity`` of every whole text.

    Null and empty texts have no words, a log probability of 0 and null means.
    Without any word in the corpus the model stays as it starts. Repeated
    rows stay repeated; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # arrays and a dictionary are sent, not objects of this package, which workers may not have
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, flat, shares = sent.value
        model, known = MaskedModel(counts), WordIds(known, len(counts) // 2, len(counts) - len(counts) // 2)
        model.flat[:] = flat
        for part, texts in _texts(batches, 1):
            spelled: list[np.ndarray] = []
            ids, at, of = _padded(texts, known, model.size, model.side, spelled)
            hashed = np.array([len(w) for w in spelled], np.int64)
            total = np.bincount(np.repeat(np.arange(len(texts)), hashed), _log_shares(np.concatenate(spelled), shares), len(texts)).astype(float)
            for a in range(0, len(at), 16_384):
                p = at[a : a + 16_384]
                total += np.bincount(of[a : a + 16_384], weights=model.log_probabilities(model.windows(ids, p), ids[p]), minlength=len(texts))
            n = np.bincount(of, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(hashed), pa.array(total)], ["id", "n_words", "hashed_words", "log_probability"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, n_words long, hashed_words long, log_probability double")
    mean = F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words"))
    return scored.withColumn("mean_log_probability", mean).withColumn("perplexity", F.exp(-F.col("mean_log_probability")))
