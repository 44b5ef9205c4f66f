"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tenderlake.llm import spelling
from tenderlake.llm.queries_spelling import op11_spelling

from ..oracle import DATA
from .cases import odd_rows, table


def counted(rows, drop_every):
    total = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{name}:{run}".encode())
            if drop_every and name is not None and mark % drop_every == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words, ratio=10):
    """Rows by comparing each word with all others of nearly its length."""
    lengths = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        around = [x for k in (-1, 0, 1) for x in lengths.get(len(w) + k, []) if x != w and near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (form, len(around), words[form] if form else None)
    rows = set()
    for w, (form, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, words[w], n_near, form_n))
    return rows


def plain(rows):
    return [tuple("" if x is None else x for x in r) for r in rows]


def got_rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("listed", [spelling.LISTED, 0])
def test_pairs_against_brute_force(spark, monkeypatch, listed):
    """With 0, every key takes the exact way."""
    monkeypatch.setattr(spelling, "LISTED", listed)
    r = random.Random(3)
    words = {}
    for _ in range(120):
        w = "".join(r.choice("aabé") for _ in range(r.randint(7, 12)))
        for _ in range(4):
            k = r.randrange(len(w) + 1)
            v = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k:], w[:k] + r.choice("abcé") + w[k + 1 :]])
            words[v] = r.choice([2, 3, 25, 40, 400])
        words[w] = r.choice([2, 30, 300, 3000])
    words = {w: n for w, n in words.items() if len(w) >= 7}
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(plain(got_rows(found))) == sorted(plain(expected(words)))


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(plain(got_rows(op11_spelling(spark, DATA)))) == sorted(plain(expected(counted(docs, 31))))


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(50, "Straßenbahn STRAßENBAHN strassenbahn strassenbahn ÀÉÎÕÜÝÞ ÀÉÎÕÜÝÞ àéîõüýþ"), (51, "x" * 5000 + " " + "x" * 5000), (51, "x" * 4999 + " " + "x" * 4999)]
    docs = table(spark, odd_rows()).select("doc_id", "text", "key", "id").union(spark.createDataFrame([(*r, "k", "i") for r in rows[-3:]], "doc_id long, text string, key string, id string"))
    for every in (None, 3):
        found = got_rows(spelling.spelling_variants(docs, drop_every=every))
        assert sorted(plain(found)) == sorted(plain(expected(counted(rows, every))))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chains_of_forms(spark):
    words = {"aaaaaaa": 10**6, "aaaaaab": 10**4, "aaaaabb": 900, "aaaabbb": 50, "aaabbbb": 2, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50}
    found = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert found["aaabbbb"]["root"] == "aaaaaaa" and found["aaabbbb"]["form"] == "aaaabbb"
    assert found["zzzzzzz"]["form"] == "zzzzzzx" and found["zzzzzzy"]["root"] == "zzzzzzy" and found["zzzzzzy"]["n_near"] == 2
