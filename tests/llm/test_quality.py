import math
import random
import re
import zlib

import numpy as np
import pytest

from sparkfold.llm.quality import classify, fit, ngram_features, score, train
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def corpus(spark):
    r, rows = random.Random(4), []
    for i in range(600):
        text = prose(r.randint(20, 120), i)
        kind = i % 4
        bad = {0: text.upper().replace(" ", "!! "), 1: text.split()[0] + (" " + text.split()[1]) * 60}.get(kind)
        rows.append((i, bad or text, 0 if bad else 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").cache()
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").cache()


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = classify(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 600
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert len(out) > 100 and sum(r.predicted == r.quality for r in out) / len(out) > 0.97


def test_held_out_labels_are_never_used(spark, corpus):
    docs, labels = corpus
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(fit(docs, labels), fit(docs, turned))


def test_ftrl_learns_and_keeps_unseen_weights_at_zero():
    rows = [(np.array([1, 2]), 1), (np.array([3, 2]), 0)] * 50
    w = train(rows, bits=4)
    assert w[1] > 0 > w[3] and w[7] == 0


def test_features_are_of_tokens_pairs_and_repeats():
    assert len(ngram_features(np.array([3, 5, 3, 5], np.uint32), 18)) == 4 + 3 + 2
    assert len(ngram_features(np.zeros(0, np.uint32), 18)) == 0


def test_odd_documents(spark, odd_docs, corpus):
    rows = classify(odd_docs, corpus[1]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == odd_docs.count() and by[3][0].score == by[4][0].score and by[0][0].score == by[1][0].score and not by[None][0].held_out
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == 0.5 for r in classify(odd_docs, empty).collect())
    assert classify(odd_docs.limit(0), empty).count() == 0
    some = spark.createDataFrame([(0, None), (None, 1), (7, 1), (7, 0), (9, 0)], "doc_id long, quality int")
    assert score(odd_docs, fit(odd_docs, some)).columns == odd_docs.columns[:5] + ["spans", "score"]


def naive_score(text, weights, bits=18):
    """Tokens, pairs and repeated words one by one, in plain integers."""
    tokens, wrap = [], 1 << 64
    for part in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or ""):
        tokens.append((zlib.crc32(part.lower().encode()) & ~1) + part.isalpha())
        if len(part) > 1 and part.isupper():
            tokens.append(zlib.crc32(b"\0capitals") & ~1)
    grams = [t * 0x94D049BB133111EB % wrap for t in tokens]
    grams += [(a * 0x9E3779B97F4A7C15 + b) * 0xBF58476D1CE4E5B9 % wrap for a, b in zip(tokens, tokens[1:])]
    grams += [0xD6E8FEB86659FD93 for i, t in enumerate(tokens) if i and t % 2 and (tokens[i - 1] == t or i > 1 and tokens[i - 2] == t)]
    odds = weights[-1] + 8.0 * sum(weights[g >> (64 - bits)] for g in grams) / max(1, len(grams))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def test_scores_equal_a_naive_scorer(spark, corpus):
    docs, labels = corpus
    weights = fit(docs, labels).astype(np.float32).astype(float)
    odd = ["", None, "A", "don't STOP_me now-- 12 12 12", "été Été ÉTÉ 東京 東京", prose(40_000, 9), "word " * 30_000]
    rows = docs.limit(60).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in score(rows, weights).collect():
        assert abs(r.score - naive_score(r.text, weights)) < 1e-6


def test_training_shuffles_before_its_one_task(spark, corpus, monkeypatch):
    plans = []
    first = type(corpus[0]).first
    monkeypatch.setattr(type(corpus[0]), "first", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), first(df))[1])
    fit(*corpus)
    assert "Coalesce" not in plans[0] and "SinglePartition" in plans[0] or "RoundRobin" in plans[0]
