"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training rows labelled 1; unlabelled rows are web text without a label. With the class prior
p, the risk of a score g is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]) for the logistic loss l, minimised over a
linear function of whole-text statistics by full gradient steps; where the second term falls below 0, its
own gradient is climbed instead. The prior is the share of label 1 among the training labels. The loss is proper,
so the logistic of g estimates the probability of label 1.

Rows with crc32(doc_id as text) mod 5 = 0 are held out: their labels and texts train nothing. Training takes at
most POSITIVES and UNLABELLED rows, those with the smallest hashes of doc_id; scoring is one pass.

Defined results: null or empty text: all statistics 0, scored like any other; null doc_id: not held out, never in
training; repeated rows: each is scored, of several labels for an id the highest counts; no positive or no
unlabelled row: every score is the prior; an empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_chunks
from .words import U, hashed, mix, words

POSITIVES, UNLABELLED = 8_000, 16_000
FOLDS, THRESHOLD = 5, 0.3
STEPS, RATE, DECAY = 400, 0.05, 1e-4
_CLASSES = (b"#*$%&|<>", b"!", bytes(range(0x41, 0x5B)), b"0123456789", b"\n", b".,;:?'\"()-", bytes(range(0x80, 0x100)), b"@_/\\=+~^`{}[]")
FEATURES = ("length", "mean_word", "symbols", "bangs", "upper", "digits", "lines", "marks", "other_bytes", "odd", "same_as_last", "same_as_before", "distinct", "distinct_pairs", "long_words")


def _tables() -> np.ndarray:
    out = np.zeros((len(_CLASSES), 256), np.uint8)
    for i, chars in enumerate(_CLASSES):
        out[i, list(chars)] = 1
    return out


_TABLES = _tables()


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    keyed = np.sort(mix(value + row.astype(U) * U(0x9E3779B97F4A7C15), 3) >> U(20) | row.astype(U) << U(44))
    new = np.r_[True, keyed[1:] != keyed[:-1]] if len(keyed) else np.zeros(0, bool)
    return np.bincount((keyed[new] >> U(44)).astype(np.int64), minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x features of whole texts, each bounded."""
    n = len(offsets) - 1
    row, start, end = words(data, offsets)
    hashes = hashed(data, start, end)
    at = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(at).astype(float)
    per = np.maximum(count, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    sym, bang, upper, digit, line, mark, high, odd = (_sums(t[data], offsets) for t in _TABLES)
    chars = _sums(end - start, at)
    last = np.zeros(len(row), bool)
    last[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    before = np.zeros(len(row), bool)
    before[2:] = (hashes[2:] == hashes[:-2]) & (row[2:] == row[:-2])
    pair = np.flatnonzero(row[1:] == row[:-1])
    pairs = np.maximum(np.bincount(row[pair], minlength=n), 1)
    distinct = _distinct(row, hashes, n) / per
    distinct_pairs = np.where(count > 1, _distinct(row[pair], mix(hashes[pair] + mix(hashes[pair + 1], 1), 2), n) / pairs, 1.0)
    shares = [
        np.log1p(count) / 10,
        np.minimum(chars / per, 20) / 10,
        np.minimum(3 * sym / per, 1),
        np.minimum(3 * bang / per, 1),
        np.minimum(3 * upper / np.maximum(chars, 1), 1),
        np.minimum(3 * digit / size, 1),
        np.minimum(5 * line / per, 1),
        np.minimum(mark / per, 1),
        np.minimum(5 * high / size, 1),
        np.minimum(10 * odd / size, 1),
        np.minimum(3 * _sums(last, at) / per, 1),
        np.minimum(3 * _sums(before, at) / per, 1),
        1 - np.where(count > 0, distinct, 1),
        1 - distinct_pairs,
        np.minimum(5 * _sums(end - start > 20, at) / per, 1),
    ]
    return np.stack(shares, axis=1)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in text_chunks(batches, "text"):
        x = statistics(data, offsets)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), lists], names=["doc_id", "kind", "x"])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, mean and scale of the linear score that minimises the non-negative risk."""
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 0.02)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    p, u = (np.c_[np.clip(x, -8, 8), np.ones(len(x))] for x in (p, u))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        rise_p, rise_u = sigmoid(gp), sigmoid(gu)
        below = (rise_u[:, None] * u).mean(0) - prior * (rise_p[:, None] * p).mean(0)
        grad = -below if negative < 0 else below - prior * ((1 - rise_p)[:, None] * p).mean(0)
        grad = grad + DECAY * np.r_[w[:-1], 0]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1], mean, scale


def _scored(model, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, "text"):
            if model is None:
                score = np.full(batch.num_rows, prior)
            else:
                w, b, mean, scale = model
                z = np.clip((statistics(data, offsets) - mean) / scale, -8, 8) @ w + b
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """The model (None without examples of both kinds) and the class prior, from rows that are not held out."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).filter(fold() != 0)
    shares = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(shares.values())
    prior = (shares.get(1, 0) + 1) / (total + 2)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(fold() != 0).join(known, "doc_id", "left")
    ids = ids.select("doc_id", F.xxhash64("doc_id").alias("h"), F.when(F.col("quality") == 1, 1).when(F.col("quality").isNull(), 0).alias("kind"))
    chosen = None
    for kind, most in ((1, positives), (0, unlabelled)):
        part = ids.filter(F.col("kind") == kind).orderBy("h", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    chosen = settle(chosen.dropDuplicates(["doc_id"]), "chosen")
    top = chosen.agg(F.max("h")).first()[0]
    if top is None:
        return None, prior
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.xxhash64("doc_id") <= F.lit(top))
    rows = settle(texts.join(chosen, "doc_id").select("doc_id", "kind", "text").mapInArrow(_described, "doc_id long, kind int, x array<double>"), "examples")
    # At most positives + unlabelled rows of fifteen numbers.
    table = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().combine_chunks()
    kind = table.column("kind").to_numpy()
    x = np.array(table.column("x").to_pylist(), float).reshape(len(kind), len(FEATURES))
    if not (kind == 1).any() or not (kind == 0).any():
        return None, prior
    return fit(x[kind == 1], x[kind == 0], prior), prior


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, quality (0 or 1)."""
    model, prior = train(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = texts.mapInArrow(_scored(model, prior), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _passing(model, prior: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches, "text"):
            if model is None:
                keep = np.full(batch.num_rows, prior >= threshold)
            else:
                w, b, mean, scale = model
                z = np.clip((statistics(data, offsets) - mean) / scale, -8, 8) @ w + b
                keep = 1 / (1 + np.exp(-np.clip(z, -40, 40))) >= threshold
            yield batch.filter(pa.array(keep))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that classify() predicts as 1; no shuffle of texts."""
    model, prior = train(docs, labels)
    return docs.mapInArrow(_passing(model, prior, threshold), docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
