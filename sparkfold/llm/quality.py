"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text's tokens are its letter runs in lower case, its digit runs and its punctuation runs, each
letter run of two or more capitals followed by a token for that. Tokens, neighbouring pairs
and, as one pattern, pairs of the same word are hashed into 2**bits features; a feature's value is its share of the text's n-grams times a constant, so a score
is a sparse dot product that needs no second pass over a text, whatever its length.

Training runs in one task on at most ``sample`` labelled rows (those of smallest hash), a documented
bound that does not grow with the corpus; the scores cover every document.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, ChunkCoder, ship_code, tidied

SCALE = 8.0
PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_CODERS: dict[str, ChunkCoder] = {}
CACHES.append(_CODERS)


class _Tokens:
    """Token hashes of chunks, by a bounded memo."""

    def __init__(self, memo_limit: int = 100_000):
        self.memo, self.memo_limit = {}, memo_limit
        self.capitals = zlib.crc32(b"\0capitals") & ~1

    def __call__(self, chunks: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > self.memo_limit:
            memo.clear()
        for chunk in set(chunks).difference(memo):
            ids = []
            for part in PARTS.findall(chunk):
                ids.append(zlib.crc32(part.lower().encode()) & ~1 | part.isalpha())  # odd: a word
                if len(part) > 1 and part.isupper():
                    ids.append(self.capitals)
            memo[chunk] = np.array(ids, "<u4").tobytes()
        return [memo[c] for c in chunks]


def _coder() -> ChunkCoder:
    if "quality" not in _CODERS:
        _CODERS["quality"] = ChunkCoder(_Tokens())
    return _CODERS["quality"]


def ngram_features(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Feature numbers of the tokens, of the pairs of neighbours, and one for each word that is the
    same as the token one or two before it."""
    t = tokens.astype(np.uint64)
    if not len(t):
        return np.zeros(0, np.int64)
    pairs = (t[:-1] * np.uint64(0x9E3779B97F4A7C15) + t[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    single = t * np.uint64(0x94D049BB133111EB)
    again = (t[1:] == t[:-1]) & (t[1:] & 1 == 1)
    again[1:] |= (t[2:] == t[:-2]) & (t[2:] & 1 == 1)
    repeats = np.full(int(again.sum()), 0xD6E8FEB86659FD93, np.uint64)
    return (np.concatenate([single, pairs, repeats]) >> np.uint64(64 - bits)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], bits: int = 18, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates over (features, label); the last weight is the bias."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    positives = sum(y for _, y in rows)
    balance = {1: len(rows) / (2 * max(positives, 1)), 0: len(rows) / (2 * max(len(rows) - positives, 1))}
    examples = []
    for features, label in rows:
        at, counts = np.unique(features, return_counts=True)
        examples.append((np.append(at, size), np.append(counts * (SCALE / max(1, len(features))), 1.0), label))
    for _ in range(epochs):
        for at, x, label in examples:
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x * balance[label]
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / alpha
            z[at] = za + g - sigma * w
            n[at] = na + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, bits: int = 18) -> np.ndarray:
    """Weights from labels (doc_id, quality) of documents that are not held out.

    Labels or ids that are null are left out; several labels of a document count by their mean. With
    no labelled rows, or one class alone, the weights still exist (bias only, or zero).
    """
    spark = docs.sparkSession
    ship_code(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # the documented bound; it also bounds the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "text")

    def featurise(batches):
        for batch in tidied(batches):
            code, labels_ = _coder(), batch.column(1).to_pylist()
            rows_ = [(k, labels_[k], ngram_features(ids, bits).astype("<i4").tobytes()) for k, ids in code(batch.column(2).to_pylist())]
            ids_ = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([ids_[k] for k, *_ in rows_], pa.int64()), pa.array([y for _, y, _ in rows_], pa.int32()), pa.array([f for *_, f in rows_], pa.binary())], ["doc_id", "label", "features"])

    def learn(batches):
        found = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2]))  # the same order in every run
        weights = train([(np.frombuffer(f, "<i4"), y) for _, y, f in found], bits)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["weights"])

    # The shuffle to one task moves the features of the sample; the scan of the documents stays spread.
    trained = rows.mapInArrow(featurise, "doc_id long, label int, features binary").repartition(1).mapInArrow(learn, "weights binary").first()
    return np.frombuffer(trained["weights"], "<f4").astype(np.float64) if trained else np.zeros((1 << bits) + 1)


def score(docs: DataFrame, weights: np.ndarray, bits: int = 18) -> DataFrame:
    """docs (with a string column text) and ``score``, the probability of label 1. A null or empty text
    scores by the bias alone."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits floats at any size of corpus

    def run(batches):
        w = shared.value.astype(np.float64)
        for batch in tidied(batches):
            odds = np.zeros(batch.num_rows)
            for k, ids in _coder()(batch.column("text").to_pylist()):
                features = ngram_features(ids, bits)
                odds[k] = w[features].sum() * SCALE / max(1, len(features)) + w[-1]
            yield batch.append_column("score", pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30)))))

    docs = docs.drop("score")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: tuple = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, *keep for every row of docs, by a classifier fitted on labels.

    The score depends on the text alone, whole at any length; a null or empty one scores by the bias.
    A null doc_id is never held out; repeated rows and rows of one doc_id score each by their text; an
    empty table gives no rows; a column of keep may have any name but the returned ones.
    """
    weights = fit(docs, labels)
    scored = score(docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]), weights)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[c for c in keep if c != "doc_id"])
