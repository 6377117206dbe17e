"""A quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import SHAPE, shape_features


def _featured(rows: DataFrame) -> DataFrame:
    """(doc_id, kind, x) of ``rows``, one row for each doc_id and kind: of several texts of a doc_id one is taken before any leaves for the driver."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = pa.array([shape_features(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), column], ["doc_id", "kind", "x"])

    return rows.select("doc_id", "kind", "text").mapInArrow(run, "doc_id long, kind int, x binary").groupBy("doc_id", "kind").agg(F.min("x").alias("x"))


def fit_nnpu(positive, unlabelled, prior: float, epochs: int = 60, rate: float = 0.02, decay: float = 1e-4, seed: int = 0):
    """Weights (last: intercept) of a logistic scorer that minimises
    ``prior * R+(P) + max(0, R-(U) - prior * R-(P))``, the non-negative unbiased risk with the logistic loss: the negative part of the
    risk is what the unlabelled have beyond the positives' share; where a batch's estimate of it falls below zero, the step goes
    the other way on that part."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mean, std = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p = np.hstack([(positive - mean) / std, np.ones((len(positive), 1))]).clip(-8, 8)
    u = np.hstack([(unlabelled - mean) / std, np.ones((len(unlabelled), 1))]).clip(-8, 8)
    w = np.zeros(p.shape[1])
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    batches = max(1, (len(p) + len(u)) // 512)
    for _ in range(epochs):
        for pi, ui in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)):
            a, b = p[pi], u[ui]
            if not len(a) or not len(b):
                continue
            za, zb = a @ w, b @ w
            negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
            plus = -prior * (a * sigmoid(-za)[:, None]).mean(axis=0)
            minus = (b * sigmoid(zb)[:, None]).mean(axis=0) - prior * (a * sigmoid(za)[:, None]).mean(axis=0)
            grad = (plus + minus if negative >= 0 else -minus) + decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum())


def estimate_prior(positive, unlabelled, seed: int = 0) -> float:
    """The share of positives among the unlabelled, from these two samples alone: a plain classifier tells positives from unlabelled; on
    the half not used to fit it, the share is bounded by the least ratio, over thresholds that keep half of the positives or more, of the
    unlabelled's and the positives' tails of high scores, less a standard error, since too high a share costs more than one too low."""
    import numpy as np

    half = lambda x, k: x[k::2]
    w = fit_nnpu(half(positive, 0), half(unlabelled, 0), 0.5, epochs=20, seed=seed)
    score = lambda x: x @ w[:-1] + w[-1]
    a, b = np.sort(score(half(positive, 1))), np.sort(score(half(unlabelled, 1)))
    cuts = np.quantile(a, np.linspace(0.01, 0.5, 50))
    tail = lambda x, c: 1 - np.searchsorted(x, c) / len(x)
    return float(np.clip(min((tail(b, c) - 0.5 / np.sqrt(len(b))) / max(tail(a, c), 1e-3) for c in cuts), 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = 8000, prior: float | None = None, seed: int = 0):
    """The scorer's weights from at most ``sample`` trusted positives and ``sample`` unlabelled texts.

    ``labels`` has doc_id and quality; rows of it where ``may_learn`` (over doc_id) isn't true, and null qualities, are never looked at.
    A doc_id with several labels counts as positive if all of them are 1. Unlabelled texts are drawn from documents under the same rule
    whatever their label. Both samples are the first doc_ids by a hash, so they don't depend on partitions; a doc_id that comes often counts once. ``prior``: estimated from
    the two samples if not given. With no positives or no documents there is no model: None."""
    import numpy as np

    first = F.xxhash64("doc_id", F.lit(seed))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(may_learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    good = known.where("q = 1").select("doc_id").orderBy(first).limit(sample).withColumn("kind", F.lit(1))
    web = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(may_learn & F.col("doc_id").isNotNull()).distinct().orderBy(first).limit(sample).withColumn("kind", F.lit(0))
    chosen = good.union(web)  # at most twice ``sample`` ids
    rows = _featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")).toPandas()  # at most twice ``sample`` rows
    kinds = rows["kind"].to_numpy()
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(-1, SHAPE).astype(np.float64)
    order = np.lexsort(x.T[::-1])  # the order in which rows arrive must not matter
    x, kinds = x[order], kinds[order]
    positive, unlabelled = x[kinds == 1], x[kinds == 0]
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    pi = estimate_prior(positive, unlabelled, seed) if prior is None else prior
    return fit_nnpu(positive, unlabelled, pi, seed=seed)


def score(docs: DataFrame, weights) -> DataFrame:
    """(doc_id, score): the score, 0 to 1, of each whole text. Null and empty texts have the features of no text and a score like any
    other. Without a model every score is 0.5. Rows are scored by themselves; nothing is shuffled."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if weights is None:
                out = np.full(batch.num_rows, 0.5)
            else:
                x = np.array([shape_features(t.as_py()) for t in batch.column("text")], dtype=np.float64).reshape(-1, SHAPE)
                out = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
