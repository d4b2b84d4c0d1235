"""Operator 5, toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import mix
from .common import flat_bytes, held_out, text_slices, train_fold

#: Lengths of the character n-grams (bytes of a word with a blank on either side).
GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
#: The model learns from at most this many labelled rows, those with the smallest hashes of their ids ...
SAMPLE_ROWS = 6000
#: ... and only from texts of at most so many characters, which bounds the sample's bytes.
SAMPLE_CHARS = 40_000
#: Documents with a score of at least this are predicted toxic.
THRESHOLD = 0.7

# Letters, digits, bytes of other scripts and the signs that stand for letters in misspellings are
# parts of words, all else separates; ASCII letters are lower-cased.
_FOLD = np.full(256, 0x20, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789@$!*":
    _FOLD[_c] = _c
for _c in range(ord("A"), ord("Z") + 1):
    _FOLD[_c] = _c + 32
_FOLD[0x80:] = np.arange(0x80, 0x100)


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, the buckets of all n-grams in words and the rows they are in."""
    rows = len(offsets) - 1
    # a blank before each row and one at the end, so that no n-gram crosses rows
    padded = np.full(len(data) + rows + 1, 0x20, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded[np.arange(len(data)) + row + 1] = _FOLD[data]
    starts = offsets + np.arange(rows + 1)
    word = padded != 0x20
    out = []
    wide = padded.astype(np.uint64) + np.uint64(1)
    for n in GRAMS:
        m = len(padded) - n + 1
        if m <= 0:
            continue
        inside = word[1 : 1 + m].copy()
        for k in range(2, n - 1):
            inside &= word[k : k + m]
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + wide[at + k]
        out.append(((mix(h) >> np.uint64(64 - 18)).astype(np.int64), np.searchsorted(starts, at, "right") - 1))
    return out


@dataclass
class Model:
    #: For each bucket, its embedding times the difference of the two softmax rows.
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, count = np.zeros(rows), np.zeros(rows)
        for bucket, row in subwords(data, offsets):
            total += np.bincount(row, self.weights[bucket], rows)
            count += np.bincount(row, minlength=rows)
        logit = np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)
        return 1 / (1 + np.exp(-logit))


def fit(texts: list[bytes], labels: np.ndarray, dim: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.05, gain: float = 100.0, least_docs: int = 5, least_z: float = 5.0, decay: float = 2e-4, seed: int = 1) -> Model:
    """Embeddings and softmax trained jointly by Adam on the mean cross-entropy.

    A row's embedding is ``gain`` times the mean of its n-grams' vectors; n-grams of fewer than
    ``least_docs`` rows, or whose shares of the two classes differ by less than ``least_z``
    standard errors, have the zero vector, as unseen ones do.
    """
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    docs = []
    for text in texts:
        found = [b for b, _ in subwords(np.frombuffer(text, np.uint8), np.array([0, len(text)]))]
        bucket, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
        docs.append((bucket, (gain * times / max(1, times.sum())).astype(np.float32)))
    spread = [np.bincount(np.concatenate([b for (b, _), y in zip(docs, labels, strict=True) if y == k]), minlength=BUCKETS) for k in (0, 1)]
    sizes = np.bincount(labels, minlength=2)
    share = (spread[0] + spread[1]) / len(labels)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (spread[1] / sizes[1] - spread[0] / sizes[0]) / np.sqrt(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]))
    used = np.flatnonzero((spread[0] + spread[1] >= least_docs) & (np.abs(np.nan_to_num(z)) >= least_z))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    docs = [(place[b][place[b] >= 0], w[place[b] >= 0]) for b, w in docs]

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(order := rng.permutation(len(docs)), max(1, len(order) // batch)):
            sizes = [len(docs[i][0]) for i in part]
            bucket = np.concatenate([docs[i][0] for i in part])
            weight = np.concatenate([docs[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), sizes)
            emb, soft, bias = params
            mean = np.stack([np.bincount(row, weight * emb[bucket, k], len(part)) for k in range(dim)], 1)
            logits = mean @ soft + bias
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            error = prob.copy()
            error[np.arange(len(part)), labels[part]] -= 1
            error /= len(part)
            back = error @ soft.T
            grads = [np.stack([np.bincount(bucket, weight * back[row, k], len(used)) for k in range(dim)], 1) + decay * emb, mean.T @ error + decay * soft, error.sum(0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    emb, soft, bias = params
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = gain * (emb @ (soft[:, 1] - soft[:, 0]))
    return Model(weights, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """A model from a bounded sample of the labelled rows of the training fold.

    The sample is the ``sample`` labelled ids with the smallest hashes; null labels, null texts
    and texts over ``SAMPLE_CHARS`` are left out, and without both classes all scores are 0.5.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & train_fold(F.col("doc_id")))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    usable = F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS)
    rows = docs.select("doc_id", "text").where(usable).join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "text").limit(sample)
    found = [(r.text.encode(), r.toxic) for r in rows.toLocalIterator()]
    return fit([text for text, _ in found], np.array([y for _, y in found]))


def _scorer(model: Model):
    def run(batches):
        for batch in text_slices(batches):
            score = model.scores(*flat_bytes(batch))
            rest = [batch.column(k) for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], [*(k for k in batch.schema.names if k != "text"), "score"])

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Scores come from the texts alone. A null or empty text has the score of a text without any
    n-gram. Repeated rows are scored each; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input rows whose score is below the threshold, with the input's columns."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in text_slices([batch], text_col):
                score = model.scores(*flat_bytes(part, text_col))
                yield part.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, schema).select(*names)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
