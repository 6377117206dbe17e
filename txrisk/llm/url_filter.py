"""URL filtering: rules first, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import gram_features

SIZES, WIDTH = (2, 3, 4), 4096
NUMBER = re.compile(rb"[0-9]+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, ``host/path``) that fits: its host is the url's or a domain above it, its path a prefix of the
    url's. Null if none fits; of equal length the first by text."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_features(host: str, path: str):
    """n-grams of host and path. A run of digits in the path counts as one 0: which page of a folder it is says nothing about the url."""
    return gram_features(f"^{host}$".encode() + NUMBER.sub(b"0", path.encode()) + b"$", SIZES, WIDTH)


def train(labelled: DataFrame, sample: int = 4000, seed: int = 0, epochs: int = 200, rate: float = 0.3, decay: float = 1e-4):
    """Weights (last: intercept) from a small labelled table (host, path, allowed boolean): at most ``sample`` rows of each label, the first by
    a hash of the url. With rows of one label only, or none, there is no weight and the model gives that label, or allows."""
    import numpy as np

    first = F.xxhash64("host", "path", F.lit(seed))
    known = labelled.where(F.col("allowed").isNotNull()).select("host", "path", "allowed").distinct()
    rows = known.where("allowed").orderBy(first).limit(sample).union(known.where("NOT allowed").orderBy(first).limit(sample)).toPandas().sort_values(["host", "path", "allowed"])
    y = rows["allowed"].to_numpy().astype(bool)
    if not len(y) or y.all() or not y.any():
        return np.append(np.zeros(WIDTH), 1.0 if not len(y) or y.all() else -1.0)
    x = np.array([url_features(h, p) for h, p in zip(rows["host"], rows["path"])], dtype=np.float64)
    sign, weight = np.where(y, 1.0, -1.0), np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    for t in range(1, epochs + 1):
        g = -(sign * weight) / (1 + np.exp(np.clip(sign * (x1 @ w), -30, 30)))
        grad = x1.T @ g + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def judge(pages: DataFrame, rules: list[tuple[str, str]], weights) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict where one fits, else ``allow`` if the model's score is 0.5 or more.

    ``pages`` has page_id and url; other columns are ignored. A null or broken url has empty host and path, fits no rule and is scored
    like any other. Rows are judged by themselves; rules run in the plan, only the score in numpy."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            z = np.array([url_features(h, p) @ weights[:-1] + weights[-1] for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())], dtype=np.float64)
            yield batch.append_column("score", pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

    id_type = pages.schema["page_id"].dataType.simpleString()
    scored = ruled.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, score double")
    verdict = F.lit(None).cast("string")
    for told, rule in rules:
        verdict = F.when(F.col("rule") == rule, told).otherwise(verdict)
    return scored.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "allow").otherwise("block")))
