"""SimHash, repeated passages, quality rules and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tenderlake.llm import decontaminate, quality_rules, simhash, substring_dedup
from tenderlake.llm.components import components

from .cases import DOCS, odd_rows, row, table, words


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs: (id, fingerprint); least id reachable over at most two differing bits."""
    at = {i: n for n, (i, _) in enumerate(pairs)}
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, f) in enumerate(pairs):
        for j, (_, g) in enumerate(pairs[:i]):
            if (f ^ g).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for n, (i, _) in enumerate(pairs):
        groups.setdefault(find(n), []).append(i)
    return {i: min(x for x in groups[find(at[i])] if x is not None) for i in at if i is not None}


def test_fingerprints_and_components(spark):
    rows = odd_rows() + [row(20 + k, words(300, 5).replace(f"w{k}", "ww", 1)) for k in range(40)]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    expect = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert {r["id"]: r["fp"] & (2**64 - 1) for r in got} == expect
    roots = brute_components(sorted(expect.items(), key=lambda x: (x[0] is None, x[0])))
    assert {r["id"]: r["component"] for r in got if r["id"] is not None} == roots


def test_large_buckets_take_the_exact_way(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = {centre} | {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = []
    for bound in (4, 10_000):
        links = simhash.near_links(df, 2, bound)
        assert all(((x["u"] ^ x["v"]) & (2**64 - 1)).bit_count() <= 2 for x in links.collect())
        roots.append({x["node"]: x["root"] for x in components(links).collect()})
    assert roots[0] == roots[1]
    exact = brute_components([(f, f & (2**64 - 1)) for f in signed])
    assert {f: roots[0].get(f, f) for f in signed} == exact


def test_components_of_a_long_chain_and_repeated_edges(spark):
    edges = [(i, i + 1) for i in range(200)] + [(5, 4), (500, 501), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    kept = simhash.keep_one(table(spark, odd_rows()))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(
        (r is None, r or 0) for r in (1, 4, 5, 7, 8, 9, None, -3)
    )
    assert simhash.keep_one(table(spark, [])).count() == 0


def test_passages_exact_fuzzy_and_shared(spark):
    shared, other = words(70, 1, 10**6), words(120, 2, 10**6)
    fuzzy = other.split()
    for i in (30, 60, 90):
        fuzzy[i] = "changed"
    del fuzzy[75]
    docs = [row(i, f"{words(40, 100 + i, 10**6)} {shared} {words(30, 200 + i, 10**6)}") for i in range(10, 40)]
    docs += [row(50, other), row(51, f"{words(60, 51, 10**6)} {' '.join(fuzzy)} {words(20, 52, 10**6)}"), row(60, words(400, 60, 10**6))]
    docs += [row(70, " ".join(shared.split()[:45]) + " " + words(50, 70, 10**6))]
    got = substring_dedup.passages(table(spark, docs)).collect()
    by = {r["id"]: r for r in got}
    assert set(by) == {*range(11, 40), 51}
    assert all((by[i]["start"], by[i]["end"], by[i]["first_ids"]) == (40, 110, [10]) for i in range(11, 40))
    assert by[51]["first_ids"] == [50] and by[51]["start"] == 60 and by[51]["end"] == 179 and by[51]["identity"] > 0.95
    cut = {r["doc_id"]: r for r in substring_dedup.cut_repeats(table(spark, docs), count_col="n_chars").collect()}
    assert len(cut) == len(docs)
    assert shared in cut[10]["text"] and cut[60]["text"] == docs[-2][1]
    assert all(shared not in cut[i]["text"] and len(cut[i]["text"].split()) == 70 for i in range(11, 40))
    assert cut[11]["n_chars"] == len(cut[11]["text"])


def test_passages_of_odd_rows(spark):
    got = substring_dedup.passages(table(spark, odd_rows())).collect()
    assert {(r["id"], tuple(r["first_ids"])) for r in got} == {(6, (5,)), (10, (-3,))}
    kept = substring_dedup.cut_repeats(table(spark, odd_rows()))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (1, 2, 3, 4, 5, 5, 7, 8, 9, None, -3)))
    assert substring_dedup.passages(table(spark, [])).count() == 0


def test_chains_prefer_order_and_pay_for_gaps():
    def chains(pos, other):
        return substring_dedup.chains_of(list(map(tuple, substring_dedup.fragments_of(pos * 0, pos, other, 6)[:, 1:].tolist())))

    pos = np.array([0, 10, 20, 30, 200])
    assert chains(pos, pos + 5) == [[(0, 5, 36)], [(200, 205, 6)]]
    crossed = chains(np.array([0, 5, 20, 26]), np.array([100, 105, 10, 126]))
    assert [(0, 100, 11), (26, 126, 6)] in crossed


def brute_repeat_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len(w), len({p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)})


def test_quality_counts(spark):
    rows = odd_rows() + [row(30, "a b c a b c d\n# <x> |\n\n# <x> |\n  \n"), row(31, "a a a a"), row(32, "x\n" * 60)]
    got = quality_rules.quality_verdicts(table(spark, rows))
    assert got.count() == len(rows)
    for r in got.collect():
        text = next(t[1] for t in rows if t[0] == r["id"]) or ""
        n, repeats = brute_repeat_words(text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (n, repeats, len(lines) - len(set(lines)))
        assert r["word_chars"] == len(re.sub(r"[\x20\x09-\x0D]", "", text)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["base_failed"] == (n < 50 or 2 * repeats > n) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_verdicts(table(spark, [])).count() == 0


def test_thresholds_follow_the_group(spark):
    plain = [row(i, words(100, i)) for i in range(60)]
    marked = [row(100 + i, words(100, i).replace(" ", " # "), "de", "b") for i in range(60)]
    outlier = [row(200, words(100, 200).replace(" ", " # ")), row(201, words(100, 201).replace(" ", " # "), "de", "b")]
    kept = {r["id"]: r["kept"] for r in quality_rules.quality_verdicts(table(spark, plain + marked + outlier)).collect()}
    assert not kept[200] and kept[201] and sum(kept.values()) == 121
    assert quality_rules.keep_good(table(spark, plain + outlier)).count() == 60


def brute_overlaps(docs, items):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for i, t in docs:
        have, hit, found = w(t), set(), set()
        for item, text in items:
            have_item = w(text)
            n = min(10, len(have_item))
            windows = {tuple(have_item[a : a + n]) for a in range(len(have_item) - n + 1)} if n else set()
            for a in range(len(have) - n + 1):
                if tuple(have[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found.add(str(item))
        out[i] = (len(have), len(hit), sorted(found))
    return out


def test_overlaps(spark):
    bench = [(0, words(30, 70)), (1, words(12, 71)), (2, "Short item, here"), (3, ""), (4, None), (5, "same " * 25), (6, words(30, 70)), (7, "five words make up this")]
    items = spark.createDataFrame([(*b, "w", "h") for b in bench], "item_id long, text string, words string, h string")
    docs = [r for r in odd_rows() if r[0] is not None]
    docs += [
        row(40, f"{words(20, 40)} {words(30, 70)} tail"), row(41, f"x {' '.join(words(30, 70).split()[5:16])} y"), row(42, "a SHORT-item here. b"),
        row(43, "same " * 40), row(44, f"{words(9, 71)} {words(12, 71).upper()}"), row(45, " ".join(words(30, 70).split()[:9])),
    ]
    expect = brute_overlaps([(r[0], r[1]) for r in docs], bench)
    for how in ({}, {"broadcast_windows": 0}):
        got = decontaminate.overlaps(table(spark, docs), items, **how).collect()
        assert {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == expect
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)
    left = decontaminate.drop_contaminated(table(spark, docs), items)
    assert {r["doc_id"] for r in left.collect()} == {i for i, x in expect.items() if not x[1]}
    assert decontaminate.overlaps(table(spark, docs), items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.overlaps(table(spark, []), items).count() == 0


def test_random_overlaps(spark):
    r = random.Random(3)
    bench = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(1, 16)))) for i in range(12)]
    docs = [row(i, " ".join(r.choice("ab") for _ in range(r.randrange(0, 60)))) for i in range(40)]
    got = decontaminate.overlaps(table(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {x["id"]: (x["n_words"], x["n_hit"], x["items"]) for x in got} == brute_overlaps([(d[0], d[1]) for d in docs], bench)
    assert hashlib.sha256(b"").hexdigest()


def test_components_of_a_hub_and_a_star_of_stars(spark):
    edges = [(10_000, i) for i in range(3_000)] + [(i, 20_000 + i) for i in range(0, 3_000, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0} and len(got) == 3_000 + 1 + 1_000


def brute_common(a, b, least):
    """Words of ``b`` in equal runs of at least ``least`` words with ``a``."""
    a, b, out = a.split(), b.split(), set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                out |= set(range(j, j + n)) if n >= least else set()
    return out


def test_two_passages_of_one_pair_are_judged_one_by_one(spark):
    docs = []
    for k, (n, gap) in enumerate(((60, 60), (60, 100), (100, 400), (500, 200))):
        p, q = words(n, 900 + k, 10**6), words(n, 910 + k, 10**6)
        docs += [row(2 * k + d, f"{words(20, 920 + 10 * k + d, 10**6)} {p} {words(gap, 960 + 10 * k + d, 10**6)} {q}") for d in (0, 1)]
    p, q = words(40, 1990, 10**6), words(40, 1991, 10**6)  # neither is a passage alone, with the 12 words between them they are
    docs += [row(20, f"{p} {words(12, 1992, 10**6)} {q}"), row(21, f"{p} {words(12, 1993, 10**6)} {q}")]
    texts = {d[0]: d[1] for d in docs}
    got = {}
    for r in substring_dedup.passages(table(spark, docs)).collect():
        got.setdefault(r["id"], set()).update(range(r["start"], r["end"]))
    assert got == {**{i: brute_common(texts[i - 1], texts[i], 50) for i in (1, 3, 5, 7)}, 21: set(range(92))}


def test_every_copy_of_a_passage_is_listed(spark):
    p, fill = words(80, 700, 10**6), [words(40, 710 + i, 10**6) for i in range(12)]
    quote = " ".join(p.split()[20:45])
    docs = [
        row(1, f"{fill[0]} {p}"),
        row(2, f"{fill[1]} {p} {fill[2]} {p} {fill[3]} {p}"),
        row(3, f"{fill[4]} {quote} {fill[5]} {p}"),
        row(4, " ".join([fill[6], p[::-1], fill[7], p[::-1], fill[8]])),
        row(5, " ".join(["x y z"] * 200)),
    ]
    got = {(r["id"], r["start"], r["end"], *r["first_ids"]) for r in substring_dedup.passages(table(spark, docs)).collect()}
    assert got == {(2, 40, 120, 1), (2, 160, 240, 1), (2, 280, 360, 1), (3, 105, 185, 1), (4, 160, 240, 4)}
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeats(table(spark, docs)).collect()}
    assert cut[2].split() == " ".join(fill[1:4]).split() and cut[4].split() == " ".join([fill[6], p[::-1], fill[7], fill[8]]).split()


def test_fuzzy_passages_near_the_limits_are_found(spark):
    r = random.Random(11)
    docs, pairs = [], 40
    for i in range(pairs):
        p = words(60, 3000 + i, 10**6).split()
        q = list(p)
        for x in r.sample(range(60), 9):
            q[x] = f"x{x}"
        del q[r.randrange(1, 59)]
        docs += [row(2 * i + d, " ".join(words(80, 4000 + 2 * i + d, 10**6).split() + (q if d else p) + words(80, 5000 + 2 * i + d, 10**6).split())) for d in (0, 1)]
    got = substring_dedup.passages(table(spark, docs)).collect()
    assert len(got) >= 0.9 * pairs and all(r["id"] % 2 and 78 <= r["start"] <= 90 and 129 <= r["end"] <= 141 and r["identity"] >= 0.8 for r in got)


@pytest.mark.parametrize("n_words", [60, 100, 200])
def test_exact_passages_whose_words_earlier_documents_quote(spark, n_words):
    """Two documents with one passage, after others that quote short overlapping pieces of it (12, 16, 19 and 30 words)."""
    docs, held = [], []
    for quote, step in ((12, 6), (16, 8), (19, 10), (30, 10)):
        for case in range(25):
            key = 10**6 + (quote * 25 + case) * 1_000 + n_words * 10**7
            p = words(n_words, key, 10**9).split()
            pieces = [p[i : i + quote] for i in range(0, n_words - quote + 1, step)]
            docs += [row(key + j, f"{words(30, key + 100 + j, 10**9)} {' '.join(piece)} {words(30, key + 200 + j, 10**9)}") for j, piece in enumerate(pieces)]
            docs += [row(key + 900 + d, f"{words(40, key + 300 + d, 10**9)} {' '.join(p)} {words(40, key + 310 + d, 10**9)}") for d in (0, 1)]
            held.append((quote, key + 901))
    found = {}
    for r in substring_dedup.passages(table(spark, docs)).collect():
        found.setdefault(r["id"], set()).update(range(r["start"], r["end"]))
    for quote in (12, 16, 19, 30):
        whole = [len(found.get(i, set()) & set(range(40, 40 + n_words))) >= 0.8 * n_words for q, i in held if q == quote]
        assert sum(whole) >= 0.95 * len(whole), (quote, sum(whole))
    assert all(i % 1000 >= 900 for i in found), "short quotes aren't passages"
