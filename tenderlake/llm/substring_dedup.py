"""Repeated passages by collinear chaining of shared k-mer seeds.

Words become codes of four bytes, once for each document, and codes are cut
into k-mers; a document keeps those whose hash is least in some sliding
window. Every place of a seed is linked to its first one (in the document
with the least id that has it), so a passage that thousands of documents
share gives thousands of links and not their square. Seeds come in two
lengths, since the first places of short ones may lie in short quotes. A pair of documents gets
the codes around its seeds alone. Runs of seeds on one diagonal are fragments;
those with enough equal words around them are chained in order, with costs for
the gaps, through a Fenwick tree. Along each chain words are aligned from the
seeds to both sides, which cuts it where they differ; passages that touch are
joined.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, small_side

#: Words in a k-mer, and k-mers in a window of which the least is kept. Equal runs of K + SPAN - 1 words always share a seed.
K = 5
SPAN = 8
#: The same for long seeds. A short seed may be first held by a document that quotes a few words of a passage; a long one is
#: first held by a document with a part of it that counts, so exact repeats are found whatever earlier documents quote.
#: Equal runs of LONG_K + LONG_SPAN - 1 words share one, which is less than a passage.
LONG_K = 20
LONG_SPAN = 24
#: Cost of a word of gap on either side; a seed of K words pays for a gap of 25 words on both.
GAP_COST = 0.1
#: Words of the shortest part of a passage (parts may have other first holders), of the shortest passage that is reported, least share of equal words.
PART_WORDS = 20
PASSAGE_WORDS = 50
IDENTITY = 0.8
#: Score that an alignment may lose, at 1 a word, before it ends, and words that it may go on without a better one.
DROP = 8
REACH = 40
#: Words around a seed in which the ends of a passage are looked for.
MARGIN = 60
#: A fragment is chained if PART_WORDS words with it have this many equal ones on diagonals up to DRIFT away.
PROMISING = 15
DRIFT = 4
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * FACTOR
    return h ^ (h >> np.uint64(29))


def codes_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A code of 32 bits for every word of the texts, and the words of each text."""
    words = [t.lower().split() if t else [] for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, (w for ws in words for w in ws)), np.uint64, size.sum()).astype(np.uint32), size


def seeds_of(codes: np.ndarray, size: np.ndarray, k: int = K, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text index, position, key`` of the seeds of texts of ``size`` words; a key comes once for each of its places."""
    flat = _mix(codes.astype(np.uint64) + FACTOR)
    if len(flat) < k:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    text = np.repeat(np.arange(len(size)), size)
    grams = np.zeros(len(flat) - k + 1, np.uint64)
    for j in range(k):
        grams = grams * FACTOR + flat[j : len(flat) - k + 1 + j]
    grams = _mix(grams)
    whole = text[: len(grams)] == text[k - 1 :]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    grams = np.where(whole, grams, top)
    # least of every window of ``span`` k-mers, by doubling; the ends of short texts are padded with the largest value
    padded = np.concatenate((grams, np.full(span, top, np.uint64)))
    least, width = padded, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    least = least[: len(grams)]
    # windows that cross into another text don't count, but for the one that a short text has
    begin = np.concatenate(([0], np.cumsum(size)))[text[: len(grams)]]
    last = np.concatenate(([0], np.cumsum(size)))[text[: len(grams)] + 1] - k
    at = np.arange(len(grams))
    counted = whole & ((at + span - 1 <= last) | (at == begin))
    starts = np.flatnonzero(counted)
    picked = np.zeros(len(grams), bool)
    for j in range(span):
        p = starts + j
        p = p[p < len(grams)]
        s = starts[: len(p)]
        picked[p[(grams[p] == least[s]) & whole[p] & (text[p] == text[s])]] = True
    at = np.flatnonzero(picked)
    return text[at], at - begin[at], grams[at]


def code_table(docs: DataFrame) -> DataFrame:
    """``doc, codes`` of ``docs(doc, text)``, written: the codes of all words, four bytes each. Of a repeated id one text counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                codes, size = codes_of(part.column(1).cast(pa.binary()).to_pylist())
                ends = np.cumsum(size)
                cells = pa.array([codes[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), cells], ["doc", "codes"])

    written = materialise(docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, codes binary"), "word-codes")
    repeated = materialise(written.groupBy("doc").count().filter("count > 1").select("doc"), "repeated-ids")
    if repeated.isEmpty():
        return written
    ids = small_side(repeated)
    one = written.join(ids, "doc", "left_semi").groupBy("doc").agg(F.min("codes").alias("codes"))
    return materialise(written.join(ids, "doc", "left_anti").union(one), "word-codes")


def seed_table(coded: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """``doc, pos, key`` of ``coded(doc, codes)``: seeds of ``k`` words and, with keys of their own, of LONG_K words.

    Equal long seeds begin with equal short ones, so both are matches of ``k`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                cells = part.column(1).to_pylist()
                size = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
                codes = np.frombuffer(b"".join(cells), np.uint32)
                of, pos, key = (np.concatenate(x) for x in zip(seeds_of(codes, size, k, span), seeds_of(codes, size, LONG_K, LONG_SPAN), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(pos.astype(np.int32)), pa.array(key.view(np.int64))], ["doc", "pos", "key"])

    return coded.mapInArrow(run, f"doc {coded.schema['doc'].dataType.simpleString()}, pos int, key long")


def fragments_of(of: np.ndarray, pos: np.ndarray, other: np.ndarray, k: int = K) -> np.ndarray:
    """Rows ``(pair, start, other start, words)``: runs of matches on one diagonal, from matches sorted by pair and ``pos``."""
    cut = np.flatnonzero((np.diff(of) != 0) | (np.diff(pos - other) != 0) | (np.diff(pos) > 2 * SPAN + k)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(pos)])) - 1
    return np.stack((of[first], pos[first], other[first], pos[last] - pos[first] + k), 1)


def chains_of(frags: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Chains of fragments ``(start, other start, words)``, the best one first.

    A chain scores the words of its fragments less the gaps between them; the
    best predecessor of a fragment ends before it on both sides and is found
    as a prefix maximum.
    """
    if len(frags) == 1:
        return [frags]
    ends = sorted({o + n for _, o, n in frags})
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ends) + 1)
    score, before = [0.0] * len(frags), [-1] * len(frags)
    waiting = sorted(range(len(frags)), key=lambda i: frags[i][0] + frags[i][2])
    done = 0
    for j in sorted(range(len(frags)), key=lambda i: frags[i][0]):
        start, other_start, n = frags[j]
        while done < len(waiting) and frags[waiting[done]][0] + frags[waiting[done]][2] <= start:
            i = waiting[done]
            done += 1
            s, o, m = frags[i]
            value, at = (score[i] + gap_cost * (s + m + o + m), i), bisect_left(ends, o + m) + 1
            while at < len(tree):
                tree[at] = max(tree[at], value)
                at += at & -at
        best, at = (-1e18, -1), bisect_left(ends, other_start + 1)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - gap_cost * (start + other_start)
        score[j] = n + max(0.0, gain)
        before[j] = best[1] if gain > 0 else -1
    out, used = [], [False] * len(frags)
    for j in sorted(range(len(frags)), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(frags[j])
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _equal_words(a: list[str], b: list[str]) -> int:
    """Words in order that two short lists have in common."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def _equal_run(a: list[int], b: list[int], i: int, j: int, i_end: int, j_end: int) -> int:
    """Equal words from ``a[i]`` and ``b[j]`` on."""
    n, most = 0, min(i_end - i, j_end - j)
    while n + 16 <= most and a[i + n : i + n + 16] == b[j + n : j + n + 16]:
        n += 16
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def extend(a: list[int], b: list[int], i0: int, j0: int, i_end: int, j_end: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Words from ``a[i0]`` and ``b[j0]`` on that align, as numbers of words and runs ``(of a, of b, equal words after them)``.

    Equal words score 1, differing ones -1 and left-out ones -1.5; the end is
    where the score is highest, and the search stops DROP below it or REACH
    words after it. For each number of edits the furthest place on every
    diagonal is kept.
    """
    most_a, most_b = i_end - i0, j_end - j0
    i = _equal_run(a, b, i0, j0, i_end, j_end)
    # by diagonal: words of a, and the path as (path before, edit, equal words after it)
    front = {0: (i, (None, (0, 0), i))}
    best, at, edits = float(i), (i, i, front[0][1]), 0
    while front:
        edits += 1
        step = {}
        low = best - DROP
        for k in range(min(front) - 1, max(front) + 2):
            i = -1
            if there := front.get(k):
                i, path, edit = there[0] + 1, there[1], (1, 1)
            if (there := front.get(k - 1)) and there[0] + 1 > i:
                i, path, edit = there[0] + 1, there[1], (1, 0)
            if (there := front.get(k + 1)) and there[0] > i:
                i, path, edit = there[0], there[1], (0, 1)
            j = i - k
            if i < 0 or i > most_a or j < 0 or j > most_b:
                continue
            n = 0
            if i < most_a and j < most_b and a[i0 + i] == b[j0 + j]:
                n = _equal_run(a, b, i0 + i, j0 + j, i_end, j_end)
                i += n
            score = i - k / 2 - 2 * edits
            if score > best:
                step[k] = (i, (path, edit, n))
                best, at, low = score, (i, i - k, step[k][1]), score - DROP
            elif score >= low and i <= at[0] + REACH:
                step[k] = (i, (path, edit, n))
        front = step
    runs, path = [], at[2]
    while path:
        runs.append((*path[1], path[2]))
        path = path[0]
    return at[0], at[1], runs[::-1]


def _columns(runs: list[tuple[int, int, int]], backwards: bool) -> list[tuple[int, int, bool]]:
    """The runs of an extension word by word, as ``(of a, of b, equal)``."""
    out = [c for i, j, n in runs for c in ([(i, j, False)] if i or j else []) + [(1, 1, True)] * n]
    return out[::-1] if backwards else out


def alike(columns: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Ranges of columns with at least IDENTITY equal words: the longest one, then those left and right of it."""
    out, waiting = [], [(0, len(columns))]
    gain = np.concatenate(([0.0], np.cumsum([1 - IDENTITY if e else -IDENTITY for _, _, e in columns])))
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < PART_WORDS:
            continue
        least = np.minimum.accumulate(gain[lo : hi + 1])
        largest = np.maximum.accumulate(gain[lo : hi + 1][::-1])[::-1]
        # for each start that is a new least, the last place that is no lower
        ends = len(largest) - 1 - np.searchsorted(largest[::-1], least - 1e-9)
        start = int(np.argmax(ends - np.arange(len(ends))))
        a, b = lo + start, lo + int(ends[start])
        if b - a < PART_WORDS:
            continue
        out.append((a, b))
        waiting += [(lo, a), (b, hi)]
    return sorted(out)


def align(words: list[int], other: list[int], frags: list[tuple[int, int, int]], k: int = K) -> list[tuple[int, int, int, int, int]]:
    """``start, end, other start, other end, equal words`` of each passage along a chain, within the two lists of words around it.

    A passage runs from a seed to both sides as far as its words align, so
    that words between two passages belong to neither. Neighbours of which
    one is shorter than a passage are joined if the gap keeps to IDENTITY.
    """
    found: list[tuple[int, int, int, int, int]] = []
    end = o_end = 0
    n_words, n_other = len(words), len(other)
    back, o_back = words[::-1], other[::-1]
    for s, o, n in frags:
        x = max(s, end, s + o_end - o)
        while x + k <= s + n:
            y = x - s + o
            if words[x : x + k] != other[y : y + k]:
                x += 1
                continue
            left, o_left, before = extend(back, o_back, n_words - x, n_other - y, n_words - end, n_other - o_end)
            right, o_right, after = extend(words, other, x, y, n_words, n_other)
            end, o_end = x + right, y + o_right
            equal, longer = sum(r[2] for r in before) + sum(r[2] for r in after), max(left + right, o_left + o_right)
            if equal >= IDENTITY * longer:
                found.append((x - left, end, y - o_left, o_end, equal))
            else:
                columns = _columns(before, True) + _columns(after, False)
                at, o_at = np.cumsum([(0, 0), *((c[0], c[1]) for c in columns)], axis=0).T + [[x - left], [y - o_left]]
                found += [(int(at[a]), int(at[b]), int(o_at[a]), int(o_at[b]), sum(c[2] for c in columns[a:b])) for a, b in alike(columns)]
            x = max(x + 1, end, s + o_end - o)
    out: list[tuple[int, int, int, int, int]] = []
    for piece in found:
        out.append(piece)
        while len(out) > 1:
            (s, e, o, oe, n), (s2, e2, o2, oe2, n2) = out[-2:]
            gap, near, far = max(s2 - e, o2 - oe), min(e - s, e2 - s2), max(e - s, e2 - s2)
            paid = (min(near, PASSAGE_WORDS) + min(far, PASSAGE_WORDS)) * (1 - IDENTITY) / IDENTITY
            if gap > paid or (gap and near >= PASSAGE_WORDS):
                break
            equal = n + n2 + _equal_words(words[e:s2], other[oe:o2])
            if equal < IDENTITY * max(e2 - s, oe2 - o):
                break
            out[-2:] = [(s, e2, o, oe2, equal)]
    return out


def matches(seeds: DataFrame) -> DataFrame:
    """``doc, first, hits``: per document and first holder of a seed, the sorted ``struct(pos, other)`` of the seeds they share.

    ``other`` is the first place of the seed in its first holder, so every
    later place of it gives one row, those in the first holder too.
    """
    # written before they are joined: a side of its own lets adaptive execution split the rows of a common seed
    shared = materialise(seeds.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-docs")
    linked = materialise(seeds.join(shared, "key"), "shared-seeds")
    firsts = materialise(linked.filter("doc = first").groupBy("key").agg(F.min("pos").alias("other")), "first-places")
    return (
        linked.join(firsts, "key")
        .filter("doc != first OR pos > other")
        .groupBy("doc", "first")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "other"))).alias("hits"))
    )


def no_cycles(pos: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which matches of a text with itself are of seeds that don't come back within PASSAGE_WORDS of their first place."""
    place, which = np.unique(other, return_inverse=True)
    least = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(least, which, pos)
    return (least - place >= PASSAGE_WORDS)[which]


def _ranges(of: np.ndarray, at: np.ndarray, margin: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, begin, end`` of the words within ``margin`` of seeds at ``at`` in the rows ``of``; ranges that touch are one."""
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    new = np.ones(len(of), bool)
    new[1:] = (np.diff(of) != 0) | (np.diff(at) > 2 * margin + k)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1
    return of[first], np.maximum(at[first] - margin, 0), at[last] + k + margin


def with_ranges(found: DataFrame, margin: int = MARGIN) -> DataFrame:
    """``doc, first, pos, other`` of ``matches`` as lists, and the ranges of words around them on both sides as ``from, words`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            size = np.diff(hits.offsets.to_numpy())
            flat = hits.flatten()
            pos, other = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            of = np.repeat(np.arange(batch.num_rows), size)
            keep = np.ones(len(of), bool)
            ends = np.cumsum(size)
            for i in np.flatnonzero(pc.equal(batch.column(0), batch.column(1)).to_numpy(zero_copy_only=False)):
                part = slice(ends[i] - size[i], ends[i])
                keep[part] = no_cycles(pos[part], other[part])
            of, pos, other = of[keep], pos[keep], other[keep]
            lists = [(of, pos), (of, other)]
            for at in (pos, other):
                row, begin, end = _ranges(of, at, margin)
                lists += [(row, begin), (row, end - begin)]
            rows = np.unique(of)
            arrays = [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))]
            for row, values in lists:
                starts = np.append(np.searchsorted(row, rows), len(row))
                arrays.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc", "first", "pos", "other", "a", "n", "oa", "on"]
    kind = found.schema["doc"].dataType.simpleString()
    return found.mapInArrow(run, f"doc {kind}, first {kind}, " + ", ".join(f"{c} array<int>" for c in names[2:]))


def promising(pos: np.ndarray, other: np.ndarray, codes: np.ndarray, others: np.ndarray, room: np.ndarray, k: int = K) -> np.ndarray:
    """Whether PART_WORDS words with the seed at ``pos`` can have PROMISING equal ones.

    A word counts if it is on the other side on a diagonal up to DRIFT away,
    so this bounds the equal words of every alignment within that drift.
    ``room`` has the begin and end of the words around the seed on both sides.
    """
    out = np.zeros(len(pos), bool)
    around = np.arange(k - PART_WORDS, PART_WORDS)
    for a in range(0, len(pos), 8192):
        p, o, r = pos[a : a + 8192, None] + around, other[a : a + 8192, None] + around, room[a : a + 8192]
        inside = (p >= r[:, :1]) & (p < r[:, 1:2])
        word = codes[np.where(inside, p, 0)]
        met = np.zeros(p.shape, bool)
        for d in range(-DRIFT, DRIFT + 1):
            q = o + d
            there = (q >= r[:, 2:3]) & (q < r[:, 3:])
            met |= there & (others[np.where(there, q, 0)] == word)
        total = np.concatenate((np.zeros((len(p), 1), np.int64), np.cumsum(met & inside, 1)), 1)
        out[a : a + 8192] = (total[:, PART_WORDS:] - total[:, :-PART_WORDS]).max(1) >= PROMISING
    return out


class Side:
    """The codes of one side of a batch of pairs, range after range."""

    def __init__(self, of: np.ndarray, begin: np.ndarray, cells: list[bytes]):
        self.size = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
        self.offset = np.cumsum(self.size) - self.size
        self.begin, self.flat = begin.astype(np.int64), np.frombuffer(b"".join(cells), np.uint32)
        self.key = (of << 32) + self.begin

    def locate(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The range of each place ``at`` of the pairs ``of``."""
        return np.searchsorted(self.key, (of << 32) + at, "right") - 1

    def words(self, i: int, begin: int, end: int) -> np.ndarray:
        """The codes of range ``i`` between two places of its text."""
        a, n = int(self.begin[i]), int(self.size[i])
        return self.flat[self.offset[i] + max(begin - a, 0) : self.offset[i] + min(max(end - a, 0), n)]


def spans_of(n_pairs: int, of: np.ndarray, pos: np.ndarray, other: np.ndarray, side: Side, other_side: Side, k: int = K) -> list[list[tuple[int, int, int, int, int]]]:
    """``start, end, other start, other end, equal words`` of the passages of each pair, from matches sorted by pair and ``pos``."""
    out: list[list] = [[] for _ in range(n_pairs)]
    if not len(of):
        return out
    frag = fragments_of(of, pos, other, k)
    which, places, room = [], [], []
    for s, at in ((side, frag[:, 1]), (other_side, frag[:, 2])):
        i = s.locate(frag[:, 0], at)
        which.append(i)
        places.append(at - s.begin[i] + s.offset[i])
        room += [s.offset[i], s.offset[i] + s.size[i]]
    room = np.stack(room, 1)
    good = frag[:, 3] >= PART_WORDS
    for shift in (np.zeros(len(frag), np.int64), frag[:, 3] - k):
        rest = np.flatnonzero(~good)
        good[rest] = promising(places[0][rest] + shift[rest], places[1][rest] + shift[rest], side.flat, other_side.flat, room[rest], k)
    kept = np.flatnonzero(good)
    frag, x, y = frag[kept], which[0][kept].tolist(), which[1][kept].tolist()
    cuts = np.flatnonzero(np.diff(frag[:, 0], prepend=-1, append=-1)) if len(frag) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        spans = out[int(frag[lo, 0])]
        home = {(s, o): (x[j], y[j]) for j, (_, s, o, _) in enumerate(frag[lo:hi].tolist(), lo)}
        empty = set()
        for chain in chains_of([tuple(f) for f in frag[lo:hi, 1:].tolist()]):
            while chain:
                # fragments in other ranges are too far apart for one passage
                here = home[chain[0][:2]]
                n = next((j for j, f in enumerate(chain) if home[f[:2]] != here), len(chain))
                part, chain = chain[:n], chain[n:]
                part = [f for f in part if not any(a <= f[0] and f[0] + f[2] <= b for a, b, *_ in spans)]
                if not part:
                    continue
                # where nothing came of the same words around the same place, nothing will
                s, o, n = part[0]
                around = (o, n, side.words(here[0], s - MARGIN, s + n + MARGIN).tobytes()) if len(part) == 1 else None
                if around in empty:
                    continue
                b, ob = int(side.begin[here[0]]), int(other_side.begin[here[1]])
                words, others = (z.flat[z.offset[i] : z.offset[i] + z.size[i]].tolist() for z, i in ((side, here[0]), (other_side, here[1])))
                found = align(words, others, [(s - b, o - ob, n) for s, o, n in part], k)
                spans += [(s + b, e + b, o + ob, oe + ob, n) for s, e, o, oe, n in found if e - s >= PART_WORDS and n >= IDENTITY * max(e - s, oe - o)]
                if around and not any(e - s >= PART_WORDS for s, e, *_ in found):
                    empty.add(around)
    return out


def aligned(pairs: DataFrame, coded: DataFrame) -> DataFrame:
    """``doc, first, start, end, other_start, other_end, identity`` of the passages of ``with_ranges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows = np.arange(part.num_rows)
                of = np.repeat(rows, pc.list_value_length(part.column(2)).to_numpy())
                pos, other = (part.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
                sides = [
                    Side(np.repeat(rows, pc.list_value_length(part.column(i)).to_numpy()), part.column(i).flatten().to_numpy(), part.column(i + 1).flatten().to_pylist())
                    for i in (4, 6)
                ]
                found = spans_of(part.num_rows, of, pos, other, *sides)
                of = pa.array([i for i, spans in enumerate(found) for _ in spans], pa.int64())
                rows = [(*x[:4], x[4] / max(x[1] - x[0], x[3] - x[2])) for spans in found for x in spans]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                ends = [part.column(i).take(of) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ends, *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.float64())], names)

    def cut(begins: str, sizes: str) -> Column:
        return F.zip_with(begins, sizes, lambda x, n: F.substring("codes", x * 4 + 1, n * 4))

    kept = materialise(pairs, "pairs")
    # only documents that are a side of some pair are moved
    held, first = (coded.join(small_side(materialise(kept.select(F.col(c).alias("doc")).distinct(), "pair-docs")), "doc", "left_semi") for c in ("doc", "first"))
    one = kept.join(held, "doc").withColumn("cells", cut("a", "n")).drop("codes")
    both = one.join(first.withColumnRenamed("doc", "first"), "first").withColumn("other_cells", cut("oa", "on"))
    names = ["doc", "first", "start", "end", "other_start", "other_end", "identity"]
    kind = coded.schema["doc"].dataType.simpleString()
    return both.select("doc", "first", "pos", "other", "a", "cells", "oa", "other_cells").mapInArrow(
        run, f"doc {kind}, first {kind}, " + ", ".join(f"{c} int" for c in names[2:6]) + ", identity double"
    )


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per repeated passage: ``id, start, end, n_words, first_ids, sources, identity``.

    ``start`` and ``end`` count words between white space (end excluded) in
    the document; ``sources`` lists the earlier ``id``s and word ranges that
    the passage repeats, ``first_ids`` their ids, ``identity`` the least share
    of equal words. Capitals A-Z don't matter. The first place of a passage in
    the document with the least id that holds it isn't listed; all others
    are, in that document too. Words that come back in a cycle of under
    PASSAGE_WORDS aren't passages of their own document. Rows with null ids or
    texts have none; of rows that repeat an id, one text counts. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    coded = code_table(rows)
    spans = materialise(aligned(with_ranges(matches(seed_table(coded))), coded), "spans")
    by_doc = Window.partitionBy("doc").orderBy("start", "end", "first")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(by_doc))
    return (
        islands.groupBy("doc", "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sort_array(F.collect_set(F.struct("first", "other_start", "other_end", "start", "end"))).alias("held"),
            F.min("identity").alias("identity"),
        )
        # a later document adds nothing where an earlier one holds all of the same words
        .withColumn("held", F.expr("filter(held, x -> NOT exists(held, y -> y.first < x.first AND y.start <= x.start AND y.end >= x.end))"))
        .withColumn("first_ids", F.array_distinct(F.col("held.first")))
        .withColumn("sources", F.expr("array_distinct(transform(held, x -> struct(x.first AS id, x.other_start AS start, x.other_end AS end)))"))
        .withColumn("n_words", F.col("end") - F.col("start"))
        .filter(F.col("n_words") >= min_words)
        .select(F.col("doc").alias("id"), "start", "end", "n_words", "first_ids", "sources", "identity")
    )


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` less the words in ``spans`` and the white space after them."""
    import re

    at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, kept = [], 0
    for start, end in spans:
        out.append(text[kept : at[min(start, len(at) - 1)]])
        kept = at[min(end, len(at) - 1)]
    return b"".join([*out, text[kept:]])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, **how) -> DataFrame:
    """``docs`` with repeated passages cut wherever they come but at their first place.

    Rows of which nothing is left are dropped; rows without a repeat are as
    they were, null and empty ones too. ``count_col`` gets the characters of
    a text that was cut.
    """
    spans = materialise(
        passages(docs, id_col, text_col, **how)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
        .withColumnRenamed("id", "__id"),
        "cuts",
    )
    # only documents with a cut are moved: the others are passed over by their ids
    ids = small_side(spans.select("__id"))
    same = F.col(id_col) == F.col("__id")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        found = (t if c is None or t is None else without_words(t.encode(), [(x["start"], x["end"]) for x in c]).decode() for t, c in zip(texts, cuts, strict=True))
        return pd.Series(list(found), dtype=object)

    untouched = docs.join(ids, same, "left_anti")
    changed = docs.join(ids, same, "left_semi").join(spans, same).drop("__id").withColumn(text_col, cut(F.col(text_col).cast("string"), "__spans"))
    changed = changed.filter(F.col(text_col).rlike(f"[^{SPACE_CLASS}]")).drop("__spans")
    if count_col in docs.columns:
        changed = changed.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
    return untouched.unionByName(changed)
