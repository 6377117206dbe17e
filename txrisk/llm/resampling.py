"""Importance resampling towards a target distribution of hashed n-grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import ordered
from .common import materialize
from .interning import BUCKETS, Counter, intern_batches

#: A piece of so many bytes of text is in numpy at a time.
PIECE = 1 << 22


def bucket_counts(texts: DataFrame, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all ``texts`` (text) fall into each bucket, repeats counted. A task sends one row for each bucket it met."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            counter = Counter(buckets)
            intern_batches(batch.column("text"), ngrams, buckets, PIECE, counter)
            total += counter.total
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """What an n-gram of each bucket adds to a text's weight: floored thousandths of the log ratio of its smoothed shares in target and source."""
    s, t = sum(source.values()), sum(target.values())
    ratio = lambda b: (float(target.get(b, 0) + 1) * float(s + buckets)) / (float(source.get(b, 0) + 1) * float(t + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weights(docs: DataFrame, gains: list[int], ngrams: tuple[int, int] = (1, 1), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc, n_words, n_features, weight) for each row of ``docs``: ``doc`` is a struct of the columns ``keep``, weight the floored mean of its n-grams' gains, 0 if it has none."""
    buckets = len(gains)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.asarray(gains, dtype=np.int64)
        for batch in batches:
            counter = Counter(buckets, table, batch.num_rows)
            intern_batches(batch.column("text"), ngrams, buckets, PIECE, counter)
            weight = counter.gained // np.maximum(counter.features, 1)  # floors
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(x, pa.int64()) for x in (counter.words, counter.features, weight)]], ["doc", "n_words", "n_features", "weight"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]]))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a key in floored thousandths, from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` (doc_id, text among its columns), with n_features, weight, score and rank.

    Texts are lower-cased in A-Z only; words are runs of digits, letters and bytes beyond ASCII; features are all runs of ``ngrams[0]`` to ``ngrams[1]`` words, repeats
    counted, in ``buckets`` by crc32. A bucket's gain compares its share in the texts of ``target`` with that in all of ``docs``. ``percent`` of the rows with ``least_words`` words or
    more are drawn, by weight and seeded noise: rank is 1, 2, ... in descending score, ties to the smaller doc_id (null last), null if not drawn. A drawn sample's
    distribution moves towards the target's without replacement.

    Null and empty texts have no feature and weight 0; a text of any length is worked through in pieces; repeated rows have ranks of their own; an empty table gives no rows, and
    an empty target makes the rarest features gain most. Of the counts only ``buckets`` numbers reach the driver."""
    count = lambda df: {r["bucket"]: r["n"] for r in bucket_counts(df, ngrams, buckets).collect()}
    gains = gains_of(count(docs), count(target), buckets)
    scored = weights(docs, gains, ngrams, tuple(dict.fromkeys(["doc_id", *keep])))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc.doc_id"), seed))
    scored = materialize(scored.withColumn("id", F.monotonically_increasing_id()), "resampling")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    placed = ordered(fit, [F.desc("score"), F.col("doc.doc_id").asc_nulls_last(), F.col("id")], name="place")
    ranked = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(*[F.col("doc").getField(c).alias(c) for c in keep], "n_features", "weight", "score", "rank")


def oracle_sql(percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS) -> str:
    """The sample of single words for DuckDB; crc32 is worked out bit by bit on the distinct words."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    values = "list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {values}), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
    noise_ = f"floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT"
    return f"""
    WITH d AS (SELECT doc_id, unnest({words}) AS w FROM documents), g AS (SELECT unnest({words}) AS w FROM benchmark),
    b AS (SELECT w, {crc} % {buckets} AS bucket FROM (SELECT w FROM d UNION SELECT w FROM g)),
    s AS (SELECT bucket, count(*) AS s FROM d JOIN b USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (w) GROUP BY bucket),
    gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {buckets})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM g) + {buckets})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
    v AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN b USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
    x AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + {noise_} AS score FROM documents LEFT JOIN v USING (doc_id)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= {least_words})
    SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * {percent} // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)"""
