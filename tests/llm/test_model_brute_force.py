"""The quality model's and the language model's scores against plain loops over their definitions."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from txrisk.llm import features, language_id, quality_model, queries


def grams(data, sizes, width):
    """The share of each hashed n-gram, one n-gram at a time."""
    out = Counter()
    for n in sizes:
        for at in range(len(data) - n + 1):
            h = n
            for byte in data[at : at + n]:
                h = (h ^ byte) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            out[(h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - (width.bit_length() - 1))] += 1
    total = sum(out.values())
    return [math.sqrt(out[i] / total) if total else 0.0 for i in range(width)]


def test_features_one_gram_at_a_time():
    rng = random.Random(1)
    for _ in range(10):
        data = rng.randbytes(rng.randint(0, 60))
        assert np.allclose(features.gram_features(data, (1, 2, 3), 256), grams(data, (1, 2, 3), 256), atol=1e-6)


def test_languages_bit_by_bit(spark, small):
    """Every document's language, score and doubt, decoded one codeword and one bit at a time from the model's weights."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs, queries.may_learn(F.col("doc_id"), 3, 1))
    languages, code, w, b, trust = model
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language_id.predict(docs, model).collect():
        text = texts[r["doc_id"]]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
            continue
        margins = language_id.text_features(text) @ w + b
        loss = [sum(trust[i][k] * math.log1p(math.exp(-margins[k] * code[i][k])) for k in range(code.shape[1])) for i in range(len(languages))]
        share = [math.exp(min(loss) - x) for x in loss]
        share = [x / sum(share) for x in share]
        best = min(range(len(loss)), key=loss.__getitem__)
        assert r["lang_pred"] == languages[best] and abs(r["score"] - share[best]) < 1e-5
        second = sorted(share)[-2] if len(share) > 1 else 0.0
        assert r["ambiguous"] == (share[best] - second < 0.2) or abs(share[best] - second - 0.2) < 1e-5


def test_quality_score_by_definition(spark, small):
    """Every document's score from the shape of its whole text; the fit lowers the non-negative risk it is about."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality_model.train(docs, labels, queries.may_learn(F.col("doc_id"), 5, 0))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_model.score(docs, weights).collect():
        z = sum(float(x) * y for x, y in zip(features.shape_features(texts[r["doc_id"]]), weights)) + weights[-1]
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-6
    rng = np.random.default_rng(3)
    positive, negative = rng.normal(1.0, 1.0, (400, 5)), rng.normal(-1.0, 1.0, (300, 5))
    unlabelled = np.vstack([rng.normal(1.0, 1.0, (300, 5)), negative])

    def risk(w):
        loss = lambda x, sign: sum(math.log1p(math.exp(-sign * (float(row @ w[:-1]) + w[-1]))) for row in x) / len(x)
        return 0.5 * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - 0.5 * loss(positive, -1))

    fitted = quality_model.fit_nnpu(positive, unlabelled, 0.5)
    assert risk(fitted) < risk(np.zeros(6)) / 5 and risk(fitted) < min(risk(-fitted), risk(fitted / 2))
    assert ((negative @ fitted[:-1] + fitted[-1]) < 0).mean() > 0.9
