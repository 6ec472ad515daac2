"""Quality classifier: supervised subword embeddings, averaged per document.

Words, pairs of neighbouring words and three-byte character n-grams are hashed to buckets; each
bucket has a learned vector. A document is the mean of its vectors (words and n-grams weigh half
each), a softmax layer gives the classes, and numpy stochastic gradient descent trains both on a
bounded sample of labelled rows. A part of the sample is kept back to fit the slope and offset
that turn the logit into a probability. As the layer is linear, scoring needs one number a bucket.

A null or empty text has no n-grams: its logit is 0 before slope and offset. Repeated rows get
equal scores. Without rows of both labels every score is the share of label 1 (1 if there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_texts, mix, pieces, sample_labels, small_batches, span_hashes, spans_where, table, text_buffers

#: Buckets for words and word pairs, and for n-grams.
WORD_BUCKETS = GRAM_BUCKETS = 1 << 15
WIDTH, EPOCHS, RATE = 8, 6, 4.0
#: Labelled documents that train the model, at most, of either label; one in five is kept back.
SAMPLE_GOOD, SAMPLE_BAD = 2500, 2000
#: (bucket, weight) pairs of 8 bytes that training holds, at most, half of them of either label; documents beyond are left out, in the order of a hash.
SAMPLE_PAIRS = 1 << 25
#: The score from which a document is good.
THRESHOLD = 0.7


def buckets(raw: np.ndarray, bounds: np.ndarray) -> tuple[tuple, tuple]:
    """(bucket of each word and word pair, row bounds), (bucket of each n-gram, row bounds)."""
    starts, ends, first = spans_where(raw > 32, bounds)
    h = span_hashes(raw, starts, ends)
    words = (h >> np.uint64(49)).astype(np.int64)
    pair = np.zeros(len(h), np.int64)
    if len(h) > 1:
        same = h[1:] == h[:-1]  # a repeated word has one bucket, whatever the word
        pair[1:] = np.where(same, 1, (mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(49)).astype(np.int64))
    pair[first[:-1][first[:-1] < len(h)]] = 0  # the first word of a row
    both = np.stack([words, pair], 1).ravel()
    n = len(raw)
    grams = np.zeros(0, np.int64)
    low, high = bounds[:-1], np.maximum(bounds[1:] - 2, bounds[:-1])
    sizes = high - low
    if n > 2:
        code = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
        code = (code * np.uint32(2654435761)) >> np.uint32(17)
        inside = np.ones(n - 2, bool)
        for k in (1, 2):
            cut = bounds[1:] - k
            inside[cut[(cut >= 0) & (cut < n - 2)]] = False
        # a row of one or two bytes has no n-gram; the marks above cover it
        grams = code[inside].astype(np.int64)
    at = np.r_[0, np.cumsum(sizes)]
    return (both, first * 2), (grams, at)


def _means(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of values[at[i]:at[i+1]], 0 for none."""
    sizes = np.diff(at)
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some]) / sizes[some]
    return out


@dataclass
class QualityModel:
    words: np.ndarray
    grams: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        (w, at_w), (g, at_g) = buckets(raw, bounds)
        return (_means(self.words[w], at_w) + _means(self.grams[g], at_g)) / 2

    def score(self, column) -> np.ndarray:
        raw, bounds = text_buffers(column)
        z = np.concatenate([self.logits(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in pieces(bounds)] or [np.zeros(0)])
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def _bags(batches):
    """label, buckets and weights of each text, as bytes; weights sum to 1, a bag holds at most all buckets."""
    for batch in batches:
        raw, bounds = text_buffers(batch.column(0))
        bags, weights = [], []
        for i in range(len(bounds) - 1):
            part = raw[bounds[i] : bounds[i + 1]]
            (w, _), (g, _) = buckets(part, np.array([0, len(part)]))
            w, n = np.unique(w, return_counts=True)
            g, k = np.unique(g, return_counts=True)
            bags.append(np.r_[w, g + WORD_BUCKETS].astype(np.int32).tobytes())
            weights.append((np.r_[n / max(1, n.sum()), k / max(1, k.sum())] / 2).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bags, pa.binary()), pa.array(weights, pa.binary())], ["label", "bag", "weights"])


def train(bags: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and softmax rows by stochastic gradient descent, both labels weighing alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (WORD_BUCKETS + GRAM_BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((2, WIDTH), np.float32)
    share = np.bincount(labels, minlength=2) / len(labels)
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - steps / total)
            steps += 1
            bag, w, y = bags[i], weights[i], labels[i]
            if not len(bag):
                continue
            rows = vectors[bag]
            h = w @ rows
            z = out @ h
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= 0.5 / share[y]
            back = p @ out
            out -= np.float32(rate * 0.1) * np.outer(p, h)
            vectors[bag] = rows - np.float32(rate) * np.sqrt(w)[:, None] * back
    return vectors, out


def _flat(share: float) -> QualityModel:
    """The model that gives every text the same score."""
    return QualityModel(np.zeros(WORD_BUCKETS), np.zeros(GRAM_BUCKETS), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))


def _learn(seen: list[tuple[int, np.ndarray, np.ndarray]], prior: float | None) -> QualityModel:
    """From (label, buckets, weights) of documents."""
    labels = np.array([r[0] for r in seen], np.int64)
    if len(set(labels.tolist())) < 2:
        return _flat(labels.mean() if len(labels) else 1.0)
    held = np.zeros(len(seen), bool)
    for y in (0, 1):  # one in five of either label
        held[np.flatnonzero(labels == y)[4::5]] = True
    bags, weights = [r[1] for r in seen], [r[2] for r in seen]
    own = [i for i in range(len(seen)) if not held[i]]
    vectors, out = train([bags[i] for i in own], [weights[i] for i in own], labels[own])
    scalar = (vectors @ (out[1] - out[0])).astype(np.float64)
    z = np.array([w @ scalar[b] for b, w in zip(bags, weights, strict=True)])
    prior = labels.mean() if prior is None else prior
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    check = held if 0 < labels[held].sum() < held.sum() else ~held
    return QualityModel(scalar[:WORD_BUCKETS], scalar[WORD_BUCKETS:], *_platt(z[check], labels[check], weight[check]))


def _trainer(prior: float | None):
    """One task's work: rows (label, bag, weights) in a fixed order to one row with the model."""

    def run(batches):
        seen, room = [], {0: SAMPLE_PAIRS // 2, 1: SAMPLE_PAIRS // 2}
        for batch in batches:
            for label, bag, weights in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                room[label] -= len(bag) // 4
                if room[label] >= 0:
                    seen.append((label, np.frombuffer(bag, np.int32), np.frombuffer(weights, np.float32)))
        model = _learn(seen, prior)
        values = np.r_[model.words, model.grams, model.slope, model.offset]
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], ["model"])

    return run


def fit(labelled: DataFrame, text: str = "text", label: str = "label", prior: float | None = None) -> QualityModel:
    """From a table of few labelled texts (label 1 good). prior: the share of label 1 among all labelled rows."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text}`"), F.col(f"`{label}`").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    bags = rows.mapInArrow(_bags, "label int, bag binary, weights binary")
    told = bags.repartition(1).sortWithinPartitions(F.xxhash64("bag", "weights"), "label", "bag", "weights").mapInArrow(_trainer(prior), "model binary").first()
    if told is None:
        return _flat(1.0)
    values = np.frombuffer(told.model)
    return QualityModel(values[:WORD_BUCKETS], values[WORD_BUCKETS:-2], float(values[-2]), float(values[-1]))


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method, towards labels a little within 0 and 1; the slope isn't negative."""
    x, c = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        c = c + np.clip(np.linalg.solve(h, x.T @ (w * (t - p)) - 1e-3 * c), -2, 2)
    return float(max(c[0], 0.0)), float(c[1])


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """key and score, the probability of label 1, for every row; with keep: all columns of docs whose score reaches THRESHOLD."""
    small_batches(docs.sparkSession)
    if keep:
        names = docs.columns
        place = names.index(text)

        def sift(batches):
            for batch in batches:
                yield batch.filter(pa.array(model.score(batch.column(place)) >= THRESHOLD))

        return docs.mapInArrow(sift, docs.schema)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def fit_on(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Trains on labelled rows of docs outside the held-out fold."""
    own = labels.where(fold(F.col("doc_id"), 4) != 2)
    known = sample_labels(own, "quality", {1: SAMPLE_GOOD, 0: SAMPLE_BAD})
    prior = own.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return fit(labelled_texts(docs, known), prior=prior)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
