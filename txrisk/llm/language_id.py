"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import gram_features

SIZES, WIDTH = (1, 2, 3), 4096
#: Texts whose features a task holds at a time.
STEP = 500
UNKNOWN = "und"


def codewords(n_classes: int, n_bits: int | None = None, seed: int = 0):
    """A code of +1 and -1, one row a class. No two columns part the classes alike, since such bits would be learnt twice and err together: up to six
    classes have every way to part them, 2^(n-1) - 1; for more, of 200 seeded tables of about 10 log2 n columns the one whose rows are farthest apart."""
    import numpy as np

    if n_classes < 2:
        return np.ones((n_classes, 1), dtype=int)
    if n_classes <= 6 and n_bits is None:
        return np.array([[1 if i == 0 or not k >> (i - 1) & 1 else -1 for k in range(1, 2 ** (n_classes - 1))] for i in range(n_classes)])
    bits = n_bits or max(15, int(np.ceil(10 * np.log2(n_classes))))
    rng, best, found = np.random.default_rng(seed), -1, None
    for _ in range(200 if n_classes < 100 else 5):
        m = rng.choice([-1, 1], size=(n_classes, 2 * bits))
        m = m[:, np.abs(m.sum(axis=0)) < n_classes]
        m = np.unique(m * m[0], axis=1)  # a column and its opposite part the classes alike
        m = m[:, rng.permutation(m.shape[1])[:bits]]
        product = m @ m.T
        np.fill_diagonal(product, -bits)
        apart = int((m.shape[1] - product.max()) // 2)
        if apart > best:
            best, found = apart, m
    return found


def text_features(text: str | None):
    return gram_features(b" " + b" ".join((text or "").lower().encode().split()) + b" ", SIZES, WIDTH)


def fit(x, y, n_classes: int, seed: int = 0, epochs: int = 100, rate: float = 0.5, decay: float = 1e-5):
    """One logistic classifier for each bit of the codewords, all at once by full gradient steps (Adam); returns (code, weights, intercepts, trust).
    ``trust`` says how often each bit is right for the texts of each class; a class's row sums to the number of bits."""
    import numpy as np

    code = codewords(n_classes, seed=seed)
    target = code[y]
    weight = (len(y) / n_classes / np.bincount(y, minlength=n_classes).clip(1))[y][:, None] / len(y)  # languages count alike
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    weight = weight.astype(np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, epochs + 1):
        g = -target * weight / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        for value, grad, i in ((w, x.T @ g + decay * w, 0), (b, g.sum(axis=0), 2)):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * grad * grad
            value -= rate * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[i + 1] / (1 - 0.999**t)) + 1e-8)
    right = (target * (x @ w + b) > 0).astype(np.float64)
    trust = np.array([right[y == i].mean(axis=0) if (y == i).any() else np.ones(code.shape[1]) for i in range(n_classes)]) + 1e-3
    return code, w, b, trust * code.shape[1] / trust.sum(axis=1, keepdims=True)


def decode(margins, code, trust=None):
    """Loss-weighted decoding: of each row of margins, the codeword of least logistic loss, where a bit's loss weighs as much for a class as
    the bit is to be trusted on it; that loss's share as a score, and whether it is ambiguous (the second codeword is nearly as near)."""
    import numpy as np

    loss = np.stack([(np.logaddexp(0, -margins * code[i]) * (1 if trust is None else trust[i])).sum(axis=1) for i in range(len(code))], axis=1)
    near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    share = near / near.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    top = np.sort(share, axis=1)
    second = top[:, -2] if top.shape[1] > 1 else np.zeros(len(top))
    return best, top[:, -1], top[:, -1] - second < 0.2


def train(docs: DataFrame, may_learn: Column, sample: int = 3000, seed: int = 0, most_languages: int = 2000):
    """A model from at most ``sample`` texts, as many of each language (two at least): (languages, code, weights, intercepts, trust), or None if there is none to
    learn from. Only rows of ``docs`` where ``may_learn`` (over doc_id) holds, with a text and a language, are looked at; the sample is the
    first of each language by a hash of doc_id, of rows that share one the text that comes first. Every value of ``lang`` is a language; over ``most_languages`` raise a ValueError,
    since their codewords would outgrow the driver."""
    import numpy as np

    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().orderBy("lang").limit(most_languages + 1).collect()
    if not counts:
        return None
    if len(counts) > most_languages:
        raise ValueError(f"lang has over {most_languages} values")
    sample = max(2, sample // len(counts))
    # of each language about ``sample`` rows by a threshold on the hash, then exactly so many of these
    spread, all_ = F.xxhash64("doc_id", F.lit(seed)), 2**63
    limits = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(all_ - 1, int(2 * all_ * (2 * sample + 20) / r["count"]) - all_)))])
    near = usable.withColumn("order", spread).where(F.col("order") <= F.try_element_at(limits, F.col("lang")))
    near = near.groupBy("lang", "order").agg(F.min("text").alias("text"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("place") <= sample)
    languages = sorted(r["lang"] for r in counts)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = pa.array([text_features(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), column], ["lang", "order", "x"])

    found = near.select("lang", "order", "text").mapInArrow(run, "lang string, order long, x binary")
    rows = found.toPandas().sort_values(["lang", "order"], kind="stable")  # at most ``sample`` of each language
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(-1, WIDTH)
    y = np.searchsorted(languages, rows["lang"].to_numpy().astype(str)) if len(rows) else np.zeros(0, dtype=int)
    return (languages, *fit(x, y, len(languages), seed)) if len(rows) else None


def predict(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row: the whole text counts. A null text, one without a letter, and every text
    where there is no model have ``und``, a score of 0 and are ambiguous. Nothing is shuffled."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            can = np.array([model is not None and t is not None and letter.search(t) is not None for t in texts], dtype=bool)
            pred, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            where = np.flatnonzero(can)
            for at in range(0, len(where), STEP):
                part = where[at : at + STEP]
                languages, code, w, b, trust = model
                best, share, doubt = decode(np.array([text_features(texts[i]) for i in part]) @ w + b, code, trust)
                for i, k in zip(part, best):
                    pred[i] = languages[k]
                score[part], unsure[part] = share, doubt
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
