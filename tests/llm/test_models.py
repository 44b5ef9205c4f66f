"""Classifiers and language model: held-out accuracy, exact neighbours, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import lm_scoring, quality_classifier, toxicity
from tenderlake.llm.common import held_out

from .cases import odd_rows, row, table, words

LABELS = "doc_id long, quality int, toxic int, id string"


def labelled(n=400):
    docs, labels = [], []
    for i in range(n):
        good, toxic = i % 5 != 0, i % 7 == 0
        w = words(60, i, 5_000).split()
        if not good:
            w = [x + "###" for x in w]
        if toxic:
            w[10:10] = ["nasty", "vile", "rotten"]
        docs.append(row(100 + i, " ".join(w)))
        labels.append((100 + i, int(good), int(toxic), "x"))
    return docs, labels


def test_quality_classifier(spark):
    docs, labels = labelled()
    df, lab = table(spark, docs + odd_rows()), spark.createDataFrame(labels, LABELS)
    got = quality_classifier.score(df, lab, held_out(F.col("id"), 3, 1)).collect()
    assert len(got) == len(docs) + len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, q, _, _ in labels}
    assert np.mean([(r["score"] >= 0.5) == truth[r["id"]] for r in got if r["held_out"] and r["id"] in truth]) > 0.95
    none = quality_classifier.score(df, lab.limit(0), held_out(F.col("id"), 3, 1)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert quality_classifier.score(table(spark, []), lab, held_out(F.col("id"), 3, 1)).count() == 0


def test_prior_estimate():
    r = np.random.default_rng(0)
    for prior in (0.2, 0.6, 0.85):
        p = r.normal(2, 1, 4000)
        u = np.where(r.random(8000) < prior, r.normal(2, 1, 8000), r.normal(-2, 1, 8000))
        assert abs(quality_classifier.estimate_prior(p, u) - prior) < 0.07


def test_block_max_neighbours_are_exact():
    r = np.random.default_rng(0)
    scale = np.linspace(1, 3, 60)

    def bag():
        terms = np.unique(np.minimum(r.exponential(12, r.integers(0, 9)).astype(int), 59))
        return terms, toxicity.unit_vector(terms, r.integers(1, 4, len(terms)), scale)

    for n in (0, 1, 300):
        bags = [bag() for _ in range(n)]
        entries = [np.array(x) for x in zip(*((i, t, w) for i, (ts, ws) in enumerate(bags) for t, w in zip(ts, ws)), strict=True)] or [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        index = toxicity.BlockMaxIndex(n, 60, *entries, block=16)
        queries = [bag() for _ in range(100)]
        some = [int(x) for x in r.integers(-1, n, 100)] if n else None
        for (terms, weights), (i, s), (other, _), out in zip(queries, index.nearest(queries, 10), index.nearest(queries, 10, some), some or [-1] * 100, strict=True):
            cosines = np.array([sum(w * dict(zip(*e)).get(t, 0) for t, w in zip(terms, weights)) for e in bags])
            expect = np.lexsort((np.arange(n), -cosines))[: min(10, (cosines > 0).sum())] if n else []
            assert np.allclose(s, cosines[i] if n else [], atol=2e-6) and np.allclose(s, [cosines[x] for x in expect], atol=2e-6) and len(set(i)) == len(i)
            assert out not in other and set(i) - {out} <= set(other)


def test_toxicity(spark):
    docs, labels = labelled()
    df, lab = table(spark, docs + odd_rows()), spark.createDataFrame(labels, LABELS)
    got = toxicity.score(df, lab, held_out(F.col("id"), 5, 0)).collect()
    assert len(got) == len(docs) + len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: t for i, _, t, _ in labels}
    assert np.mean([(r["score"] >= 0.5) == truth[r["id"]] for r in got if r["held_out"] and r["id"] in truth]) > 0.95
    assert all(r["score"] < 0.5 for r in got if r["id"] not in truth)
    assert not set(sum((r["neighbours"] for r in got), [])) & {r["id"] for r in got if r["held_out"]}
    assert {r["score"] for r in toxicity.score(df, lab.limit(0), held_out(F.col("id"), 5, 0)).collect()} == {0.0}
    assert toxicity.score(table(spark, []), lab, held_out(F.col("id"), 5, 0)).count() == 0


def test_toxicity_neighbours_are_those_of_whole_texts(spark):
    docs, labels = labelled(150)
    df, lab = table(spark, docs + odd_rows()), spark.createDataFrame(labels + [labels[0]], LABELS)
    got = toxicity.score(df, lab, held_out(F.col("id"), 5, 0), k=5).collect()
    held = {r["id"] for r in got if r["held_out"]}
    texts = {d[0]: toxicity.Counter(toxicity.terms_of((d[1] or "").encode())) for d in docs + odd_rows()}
    truth = {i: t for i, _, t, _ in labels if i not in held}
    n = toxicity.Counter(t for i in truth for t in texts[i])
    rows = docs + odd_rows()
    often = toxicity.Counter(t for d in rows for t in set(toxicity.terms_of((d[1] or "").encode())))
    weigh = lambda bag: {t: (1 + np.log(c)) * (np.log((1 + len(rows)) / (1 + often[t])) + 1) for t, c in bag.items() if t in n}
    unit = lambda v: {t: x / np.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
    vectors = {i: unit(weigh(texts[i])) for i in truth}
    for r in got:
        if r["id"] is None:
            continue
        q = unit(weigh(texts[r["id"]]))
        cosines = {i: sum(x * v.get(t, 0) for t, x in q.items()) for i, v in vectors.items()}
        assert np.allclose(r["cosines"], [c for c in sorted(cosines.values(), reverse=True)[:5] if c > 0], atol=2e-6)
        assert np.allclose(r["cosines"], [cosines[i] for i in r["neighbours"]], atol=2e-6)
    assert sum(bool(r["neighbours"]) for r in got if r["id"] in texts and 100 <= (r["id"] or 0)) == len(docs)


def test_toxicity_votes_by_stretched_distance():
    r = np.random.default_rng(3)
    bags = [np.sort(r.choice(40, 6, replace=False)) for _ in range(20)]
    entries = np.repeat(np.arange(20), 6), np.concatenate(bags), np.full(120, 6**-0.5)
    stretch = 1 + 9 * r.random(40)
    dense = np.zeros((20, 40))
    for i, b in enumerate(bags):
        dense[i, b] = stretch[b]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    near = toxicity.Stretched(20, *entries, stretch)
    for i in range(20):
        some = r.choice(20, 7, replace=False)
        assert np.allclose(near.cosines(bags[i], np.full(6, 6**-0.5), some), dense[some] @ dense[i])
    assert toxicity.vote(np.array([1.0, 0.0]), np.array([1.0, 0.5]), 0.0) > 0.9 and toxicity.vote(np.zeros(0), np.zeros(0), 0.3) == pytest.approx(0.3)


def test_toxicity_reads_only_stretched_terms_of_known_neighbours():
    r = np.random.default_rng(4)
    bags = [np.sort(r.choice(400, 60, replace=False)) for _ in range(30)]
    weights = [w / np.linalg.norm(w) for w in r.random((30, 60)) + 0.1]
    entries = np.repeat(np.arange(30), 60), np.concatenate(bags), np.concatenate(weights)
    stretch = np.ones(400)
    stretch[:12] += 9 * r.random(12)
    dense = np.zeros((30, 400))
    for i, b in enumerate(bags):
        dense[i, b] = weights[i]
    wide = dense * stretch
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    near = toxicity.Stretched(30, *entries, stretch)
    assert len(near.few[1]) == np.isin(entries[1], np.arange(12)).sum() < len(near.all[1]) / 10
    near.all = None  # with plain cosines at hand the other entries aren't read
    for i in range(30):
        some = r.choice(30, 9, replace=False)
        assert np.allclose(near.cosines(bags[i], weights[i], some, np.round(dense[some] @ dense[i], 6)), wide[some] @ wide[i], atol=2e-6)


def test_toxicity_examples_are_bounded_by_bytes(spark):
    docs, labels = labelled(60)
    df, lab = table(spark, docs), spark.createDataFrame(labels, LABELS)
    size = sum(len(d[1].encode()) for d in docs) / len(docs)
    got = toxicity.score(df, lab, held_out(F.col("id"), 5, 0), evidence=1000, k=1000, example_bytes=int(size * 20)).collect()
    assert 10 <= len(set(sum((r["neighbours"] for r in got), []))) <= 30
    assert {r["score"] for r in toxicity.score(df, lab, held_out(F.col("id"), 5, 0), example_bytes=0).collect()} == {0.0}


def naive_log_probability(model, ids, at):
    """Of one place, from the weights alone."""
    h = model.bias.astype(float).copy()
    for j, d in enumerate([d for d in range(-model.side, model.side + 1) if d]):
        h += model.context[j][ids[at + d]]
    h = np.tanh(h)
    c, m = model.class_of[ids[at]], model.member_of[ids[at]]
    by_class = np.exp(h @ model.to_class + model.class_bias)
    by_member = np.exp(h @ model.to_member[c] + model.member_bias[c])
    return np.log(by_class[c] / by_class.sum()) + np.log(by_member[m] / by_member.sum())


def test_model_probabilities_add_up():
    r = np.random.default_rng(0)
    model = lm_scoring.MaskedModel(r.integers(1, 50, 64).astype(float), width=4)
    model.flat += r.normal(0, 0.3, len(model.flat)).astype(np.float32)
    around = np.repeat(r.integers(0, 65, (4, 1)), 64, 1)
    assert abs(np.exp(model.log_probabilities(around, np.arange(64))).sum() - 1) < 1e-5


def test_training_follows_the_gradient():
    r = np.random.default_rng(1)
    ids = np.concatenate([np.full(2, 64), np.tile(np.arange(64), 40), np.full(2, 64)])
    model = lm_scoring.MaskedModel(np.ones(64), width=8)
    at = np.arange(2, len(ids) - 2)
    before = model.log_probabilities(model.windows(ids, at), ids[at]).mean()
    for _ in range(30):
        for p in np.array_split(r.permutation(at), 20):
            model.step(model.windows(ids, p), ids[p], 2.0)
    assert model.log_probabilities(model.windows(ids, at), ids[at]).mean() > before / 2


def test_a_batch_is_normalised_as_a_whole(monkeypatch):
    calls = []
    whole = lm_scoring._settled
    monkeypatch.setattr(lm_scoring, "_settled", lambda z: calls.append(len(z)) or whole(z))
    r = np.random.default_rng(2)
    model = lm_scoring.MaskedModel(r.integers(1, 50, 256).astype(float))
    model.flat += r.normal(0, 0.3, len(model.flat)).astype(np.float32)
    around, target = r.integers(0, 257, (4, 500)), r.integers(0, 256, 500)
    found = model.log_probabilities(around, target)
    model.step(around, target, 1.0)
    assert calls == [500] * 4  # twice for each, however many classes there are
    assert np.isfinite(found).all()
    # logits that single precision couldn't raise e to
    model.to_class *= 200
    model.to_member *= 200
    ids = np.concatenate([np.append(a, t) for a, t in zip(around.T, target)])
    far = model.log_probabilities(around, target)
    for i in range(0, 500, 50):
        padded = np.insert(ids[5 * i : 5 * i + 4], 2, target[i])
        with np.errstate(divide="ignore"):
            expect = naive_log_probability(model, padded, 2)
        assert np.isclose(far[i], expect, rtol=1e-3, atol=1e-3) or (expect == -np.inf and far[i] < -80)
    model.step(around, target, 1.0)
    assert np.isfinite(model.flat).all()


def test_words_without_ids_are_hashed_once():
    known = lm_scoring.WordIds({b"a": 0, b"b": 1}, 2, 5)
    hashes: list[np.ndarray] = []
    text = b"a zq b xx zq a"
    ids, at, of = lm_scoring._padded([text, None, b"xx"], known, 7, 1, hashes)
    words = [text.split(), [], [b"xx"]]
    assert ids[at].tolist() == [known[w] for x in words for w in x] and of.tolist() == [0] * 6 + [2]
    rest = [[w for w in x if w not in known] for x in words]
    assert [h.tolist() for h in hashes] == [[lm_scoring.xxhash.xxh64_intdigest(w) for w in x] for x in rest]
    listed = np.array([lm_scoring.xxhash.xxh64_intdigest(b"xx")], np.uint64)
    shares = listed, np.array([-0.5], np.float32), np.linspace(-3, -1, 5).astype(np.float32)
    assert (lm_scoring._log_shares(np.concatenate(hashes), shares) == lm_scoring._log_shares(sum(rest, []), shares)).all()


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH", 256)  # the table is small
    docs = [row(100 + i, " ".join(f"a{(i + j) % 20}" for j in range(200))) for i in range(30)] + [row(200, words(200, 1, 20).replace("w", "a"))]
    docs += [row(201, " ".join(f"zq{x}" for x in range(200)))]
    got = {}
    for rounds in (0, 12):
        rows = lm_scoring.score(table(spark, docs + odd_rows()), size=64, rounds=rounds, rate=2.0).collect()
        got[rounds] = {r["id"]: r for r in rows}
        assert len(rows) == len(docs) + len(odd_rows())
    assert got[12][100]["mean_log_probability"] > got[0][100]["mean_log_probability"]
    assert got[12][100]["mean_log_probability"] > got[12][200]["mean_log_probability"] > got[12][201]["mean_log_probability"]
    assert got[12][201]["hashed_words"] == 200 and got[12][1]["log_probability"] == 0 and got[12][1]["mean_log_probability"] is None and got[12][8]["n_words"] == 30_000
    assert lm_scoring.score(table(spark, [])).count() == 0


def test_lm_scores_are_sums_over_all_words_and_free_of_partitions(spark):
    docs = [row(100 + i, words(40 + i, i, 90)) for i in range(50)] + odd_rows()[:6] + odd_rows()[8:]
    rows = [(r[0], r[1]) for r in docs]
    known, counts, flat, shares = lm_scoring.train(spark.createDataFrame(rows, "id long, text string").repartition(5), size=64, shard_documents=10)
    model, known = lm_scoring.MaskedModel(counts), lm_scoring.WordIds(known, 32, 32)
    model.flat[:] = flat
    occurs = lm_scoring.Counter(w for _, t in rows for w in lm_scoring.words_of((t or "").encode()))
    assert counts.sum() == sum(occurs.values())
    hashes = set(shares[0].tolist())
    listed = {w for w in occurs if w not in known and lm_scoring.xxhash.xxh64_intdigest(w) in hashes}
    totals, others, n_others = lm_scoring.Counter(), lm_scoring.Counter(), lm_scoring.Counter()
    for w, c in occurs.items():
        if w not in known:
            totals[known[w]] += c
            if w not in listed:
                others[known[w]] += c
                n_others[known[w]] += 1
    assert 0 < len(listed) < len(occurs) - 32 and min(occurs[w] for w in listed) > max(c for w, c in occurs.items() if w not in known and w not in listed)
    # the words of an id share its probability
    for b in range(32):
        here = [w for w in occurs if w not in known and known[w] == 32 + b]
        assert not here or abs(np.exp(lm_scoring._log_shares(here, shares)).sum() - 1) < 1e-5
    for parts in (1, 7):
        for r in lm_scoring.score(table(spark, docs).repartition(parts), size=64, shard_documents=10).collect():
            if r["id"] in (None, 5):
                continue
            ids, at, _ = lm_scoring._padded([next(t for i, t in rows if i == r["id"]) and next(t for i, t in rows if i == r["id"]).encode()], known, 64, model.side)
            expect = sum(naive_log_probability(model, ids, x) for x in at[:400])
            text = next(t for i, t in rows if i == r["id"]) or ""
            for w in lm_scoring.words_of(text.encode()):
                if w not in known:
                    b = known[w]
                    expect += np.log((occurs[w] if w in listed else others[b] / n_others[b]) / totals[b])
            if len(at) <= 400:
                assert abs(r["log_probability"] - expect) < 1e-3 * max(1, len(at) / 10) and r["n_words"] == len(at)
