"""Packing of tokenised documents into windows by minimum bin slack.

A document's ids fill whole windows first; what remains of it, shorter than
a window, goes into a pool. From the pool each window takes the multiset of
lengths whose sum is closest to its capacity, found by a subset-sum program
over a bitset, whose steps are traced back to counts. Where the best sum
leaves a gap, one more piece is cut to fill it. Every task packs the rows of
its own partition, with a pool of bounded size, so nothing is shuffled. What
is left at the end of a task goes into windows whose lengths are powers of
two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache

#: Ids to a window, the id that ends a document, and the ids that a task's pool holds before windows are filled from it.
WINDOW = 4096
END_ID = 2
POOL_WINDOWS = 64
#: Words whose ids a worker remembers, and bytes of them (a text without spaces is one word).
CACHE_WORDS = 1_000_000
CACHE_BYTES = 32 << 20


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, so that words can be encoded one by one and remembered.

    ASCII letters are lower-cased, and full stops and commas after a letter
    split off, only in texts where that can't change an id: none with a
    combining mark or with the start of a special token. New words of
    lower-case letters alone (ASCII and Latin-1), which the tokenizer
    neither normalises nor splits, are encoded many at a time without these
    steps, where its model marks the ends of words.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.plain, self.is_end = self._plain_model(Tokenizer.from_file(path))
        self._reset()

    def _plain_model(self, model) -> tuple:
        """The tokenizer without normalising, and which ids end a word; none if the model doesn't mark them or plain words differ in a trial."""
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        mark = getattr(model.model, "end_of_word_suffix", None)
        if not mark:
            return None, None
        vocabulary = model.get_vocab()
        is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        is_end[[i for word, i in vocabulary.items() if word.endswith(mark)]] = True
        model.normalizer = None
        model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7]
        trial = [*letters, *(a + b + a for a, b in zip(letters, letters[7:] + letters[:7], strict=True)), "".join(letters)]
        self.plain, self.is_end = model, is_end
        ids, size = self._encode_plain(" ".join(trial).encode())
        whole = [e.ids for e in self.model.encode_batch(trial, add_special_tokens=False)]
        return (model, is_end) if size.tolist() == list(map(len, whole)) and ids.tolist() == sum(whole, []) else (None, None)

    def _encode_plain(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters with spaces between, and how many each has."""
        ids = np.array(self.plain.encode_batch_fast([words.decode()], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)

    def _encode(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """``words`` in some order, their ids and how many each has."""
        is_plain = process_cache("plain_word", _plain_word).fullmatch
        plain, rest = [], []
        for w in words:
            (plain if is_plain(w) else rest).append(w)
        if not self.plain:
            plain, rest = [], words
        ids, size = self._encode_plain(b" ".join(plain)) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        assert len(size) == len(plain) and size.sum() == len(ids)
        if rest:
            encoded = [e.ids for e in self.model.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
            size = np.append(size, np.fromiter(map(len, encoded), np.int64, len(rest)))
            ids = np.append(ids, np.fromiter(chain.from_iterable(encoded), np.uint32, sum(map(len, encoded))))
        return plain + rest, ids, size

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 18, np.int64)
        self.lengths = np.zeros(1 << 18, np.int64)
        self.used = self.bytes = 0

    def _learn(self, words: list[bytes]) -> None:
        if self.known and (len(self.known) > CACHE_WORDS or self.bytes > CACHE_BYTES):
            raise OverflowError
        self.bytes += sum(map(len, words))
        words, ids, size = self._encode(words)
        n, total = len(self.known), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + total] = ids
        self.starts[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.lengths[n : n + len(words)] = size
        self.used += total
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, -1 for those not remembered."""
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, text: bytes | None) -> np.ndarray:
        """The ids of a text as the tokenizer gives them for the whole of it."""
        if not text:
            return np.zeros(0, np.uint32)
        # combining marks, U+0300 to U+036F, begin with one of two bytes
        if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
            text = process_cache("after_letter", _after_letter).sub(rb" \g<0>", text.lower())
        words = text.split()
        at = self._places(words)
        new = np.flatnonzero(at < 0)
        if len(new):
            some = [words[i] for i in new.tolist()]
            try:
                self._learn(list(dict.fromkeys(some)))
                at[new] = self._places(some)
            except OverflowError:
                self._reset()
                self._learn(list(dict.fromkeys(words)))
                at = self._places(words)
        size = self.lengths[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _after_letter():
    import re

    # letters of ASCII and of Latin-1; the mark comes first, so that the search can skip to one
    return re.compile(rb"[.,](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))(?=[ \n]|\Z)")


def _plain_word():
    import re

    return re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is the largest up to ``capacity``.

    Bit s of the set is on if some multiset sums to s. Counts are split into
    powers of two; the set before each step is kept and the steps traced back
    from the best sum. Longer lengths come first, and shorter ones only until
    the capacity is met, which leaves these to close later gaps.
    """
    mask, reach = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    full = 1 << capacity
    for length in sorted(counts, reverse=True):
        if reach & full:
            break
        left, lot = min(counts[length], capacity // length), 1
        while left > 0:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= (reach << (length * lot)) & mask
            left -= lot
            lot *= 2
    target, taken = reach.bit_length() - 1, defaultdict(int)
    assert target <= capacity and (target < capacity or reach & full)
    for length, lot, before in reversed(steps):
        whole = length * lot
        if whole <= target and before >> (target - whole) & 1:
            taken[length] += lot
            target -= whole
    return dict(taken)


class Packer:
    """Windows of one task. ``out`` gets rows of pieces; pieces are (row, start, ids, total)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, pool_windows: int = POOL_WINDOWS):
        self.window, self.most, self.sequence = window, pool_windows * window, first_sequence
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.held = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for a in range(0, whole, self.window):
            self._emit([(doc, a, ids[a : a + self.window], len(ids))])
        if whole < len(ids):
            self._keep((doc, whole, ids[whole:].copy(), len(ids)))
        while self.held >= self.most:
            self._fill()

    def _keep(self, piece: tuple) -> None:
        self.pool[len(piece[2])].append(piece)
        self.held += len(piece[2])

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= length
        return piece

    def _cut(self, length: int) -> tuple:
        """``length`` ids from the front of the longest piece, the rest of which stays in the pool."""
        doc, start, ids, total = self._take(max(self.pool))
        if len(ids) > length:
            self._keep((doc, start + length, ids[length:], total))
        return doc, start, ids[:length], total

    def _fill(self, size: int | None = None) -> None:
        """One window of ``size`` ids from a pool that holds at least as many."""
        size = size or self.window
        pieces = [self._take(k) for k, n in best_fill({k: len(v) for k, v in self.pool.items() if k <= size}, size).items() for _ in range(n)]
        while gap := size - sum(len(p[2]) for p in pieces):
            piece = self._cut(gap)
            pieces.append(piece)
        self._emit(pieces)

    def finish(self) -> None:
        while self.held >= self.window:
            self._fill()
        while self.held:
            self._fill(1 << (self.held.bit_length() - 1))


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, pool_windows: int = POOL_WINDOWS
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are the end id alone. Repeated rows are packed each.
    Null ids stay null. An empty table gives an empty result. Sequence ids
    are unique, in order within a partition of ``docs``; a task run again on
    the same partition gives the same rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = process_cache(f"tokenizer:{tokenizer_path}", lambda: WordTokenizer(tokenizer_path))
        packer = Packer(TaskContext.get().partitionId() << 40, window, pool_windows)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [[]] * 7
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        kind, names = pa.int64(), ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            kind = batch.column(0).type
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    packer.add(doc, np.append(model.ids(text), np.uint32(END_ID)))
            yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rest = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, {rest}")
