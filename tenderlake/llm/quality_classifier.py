"""Quality classifier by positive-unlabelled learning.

A small network is trained on trusted positives and unlabelled text by the
non-negative form of the unbiased risk. The share of positives in the
unlabelled text, which the risk needs, is estimated from where the two
score distributions part. Negative labels are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows that the fit may use, of either kind; they are chosen by a hash of their id.
POSITIVE_ROWS = 8_000
UNLABELLED_ROWS = 16_000
HIDDEN = 24
EPOCHS = 40
BATCH = 512

#: Byte classes whose shares are features.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".",
    "comma": b",",
    "shout": b"!?",
    "symbol": b"#*$%&|<>",
    "link": b"/:@_=\\~^+",
    "bracket": b"()[]{}\"'`;-",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
FEATURES = len(CLASSES) + 17


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES)))
    for j, members in enumerate(CLASSES.values()):
        m[list(members), j] = 1
    return m


def features_of(text: bytes | None) -> np.ndarray:
    """Shape of a whole text: shares of byte classes, word and line lengths, repetition. Zeros for none."""
    out = np.zeros(FEATURES, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    n_bytes, n = len(text), len(words)
    out[: len(CLASSES)] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _class_matrix() / n_bytes
    size = np.fromiter(map(len, words), np.int32, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_size = np.fromiter(map(len, lines), np.int64, len(lines))
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    low = text.lower().split()
    pairs = len(set(zip(low, low[1:], strict=False)))
    triples = len(set(zip(low, low[1:], low[2:], strict=False)))
    kinds = len(set(low))
    caps = sum(map(bytes.istitle, words)) / n
    marked = sum(map(bytes.isalpha, words)) / n
    out[len(CLASSES) :] = (
        np.log1p(n),
        size.mean(),
        size.std(),
        np.mean(size <= 3),
        np.mean(size == 1),
        np.mean(size >= 10),
        kinds / n,
        kinds / np.sqrt(n),
        pairs / max(1, n - 1),
        triples / max(1, n - 2),
        caps,
        marked,
        np.log1p(n / (stops + 1)),
        np.log1p(line_size.mean()),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(text.count(b"http") / n * 100),
    )
    return out


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, x`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, FEATURES), np.float32)
            for a in range(0, batch.num_rows, 500):
                for i, t in enumerate(batch.column(1).slice(a, 500).cast(pa.binary()).to_pylist(), a):
                    rows[i] = features_of(t)
            x = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, x array<float>")


class Network:
    """One hidden layer on standardised features; ``logit`` of the positive class."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, hidden: int = HIDDEN, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w1, self.b1 = r.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden)
        self.w2, self.b2 = r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -5, 5)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w1 + self.b1)
        return h, h @ self.w2 + self.b2[0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x))[1]

    def gradient(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = np.outer(g, self.w2) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """The network of least non-negative risk, for a share ``prior`` of positives in ``unlabelled``.

    Risk: prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), l the
    logistic loss. Where the second part of a batch is below zero, the step
    goes up on it instead of down on the whole.
    """
    r = np.random.default_rng(seed)
    net = Network(unlabelled.mean(0), unlabelled.std(0) + 1e-3, seed=seed)
    p_all, u_all = net.scaled(positive), net.scaled(unlabelled)
    weights = [net.w1, net.b1, net.w2, net.b2]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = r.permutation(len(u_all))
        for a in range(0, len(order), BATCH):
            u = u_all[order[a : a + BATCH]]
            p = p_all[r.integers(0, len(p_all), min(BATCH, 4 * len(p_all)))]
            (hp, gp), (hu, gu) = net.forward(p), net.forward(u)
            rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            down_p, down_u = -prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
            if rest >= 0:
                dp, du = down_p - prior * sigmoid(-gp) / len(gp), down_u
            else:
                dp, du = -down_p, -down_u
            step = [x + y for x, y in zip(net.gradient(p, hp, dp), net.gradient(u, hu, du), strict=True)]
            t += 1
            for w, g, mi, vi in zip(weights, step, m, v, strict=True):
                g = g + 1e-4 * w
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                w -= 0.003 * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled scores, from scores of positives that the scorer was not fitted on.

    At a threshold, the share of unlabelled rows above it is at least the
    prior times the share of positives above it. The least ratio, with a
    margin for the sampling error of both shares, estimates the prior.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.99, 100))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> tuple[Network, float]:
    """Network and estimated prior. The prior comes from two scorers, each fitted on the other half."""
    priors = []
    for half in (0, 1):
        scorer = fit(positive[half::2], unlabelled[half::2], 0.5, epochs=max(2, EPOCHS // 4), seed=seed + half)
        priors.append(estimate_prior(scorer.logit(positive[1 - half :: 2]), scorer.logit(unlabelled[1 - half :: 2])))
    prior = float(np.mean(priors))
    return fit(positive, unlabelled, prior, seed=seed), prior


def _rows(df: DataFrame, most: int) -> np.ndarray:
    """Features of at most ``most`` rows, those with the least hash of their id."""
    got = df.orderBy(F.xxhash64(F.col("id").cast("string")), "x").limit(most).select("x").toArrow().column(0).combine_chunks()
    flat = got.chunk(0).flatten() if isinstance(got, pa.ChunkedArray) else got.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(np.float64)


def score(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    positive_rows: int = POSITIVE_ROWS,
    unlabelled_rows: int = UNLABELLED_ROWS,
) -> DataFrame:
    """``id, held_out, score`` of every row of ``docs``.

    ``held_out`` is a condition on ``id``; rows that meet it are not used in
    the fit. Only positive labels are read; an id with several labels is
    positive if any is. Null and empty texts have features of zero and get
    the score of those. Without positives or unlabelled rows every score is
    0.5. Repeated rows stay repeated; other columns are not read.
    """
    x = materialise(feature_table(docs, id_col, text_col), "quality-features").withColumn("held_out", held_out)
    known = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    fit_rows = x.filter("NOT held_out")
    positive = _rows(fit_rows.join(known, "id", "left_semi"), positive_rows)
    unlabelled = _rows(fit_rows, unlabelled_rows)
    net = train(positive, unlabelled)[0] if len(positive) >= 2 and len(unlabelled) >= 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            out = sigmoid(net.logit(rows)) if net else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["id", "held_out", "score"])

    kind = x.schema["id"].dataType.simpleString()
    return x.select("id", "held_out", "x").mapInArrow(run, f"id {kind}, held_out boolean, score double")
