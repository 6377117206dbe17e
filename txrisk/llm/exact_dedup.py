"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, with_row_id

#: Two primes below 2^31 and a base for each. Sums of byte * power over one block stay below 2^64.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
BLOCK = 1 << 16
#: Texts of more bytes are cut into chunks of so many, which are hashed in tasks of their own.
CHUNK = 1 << 24


def block_hash(data, primes=PRIMES) -> tuple[int, ...]:
    """The polynomial hashes of one block of at most ``BLOCK`` bytes, first byte at the highest power. Zero bytes count: each
    byte enters as its value plus one."""
    import numpy as np

    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int((x * _powers(p, b)[len(_powers(p, b)) - len(x) :]).sum() % np.uint64(p)) for p, b in zip(primes, BASES))


_cache: dict[tuple[int, int], object] = {}


def _powers(prime: int, base: int):
    """base^(BLOCK-1) ... base^0 modulo prime."""
    if (prime, base) not in _cache:
        import numpy as np

        out = [1] * BLOCK
        for i in range(BLOCK - 2, -1, -1):
            out[i] = out[i + 1] * base % prime
        _cache[prime, base] = np.array(out, dtype=np.uint64)
    return _cache[prime, base]


def combine(left: tuple[int, ...], right: tuple[int, ...], right_length: int, primes=PRIMES) -> tuple[int, ...]:
    """The hash of a concatenation from those of its parts: shift the left by the right's length, then add. Associative, so
    blocks of a huge text may be hashed anywhere and combined in any grouping that keeps their order."""
    return tuple((a * pow(b, right_length, p) + c) % p for a, c, p, b in zip(left, right, primes, BASES))


def fingerprint(data: bytes, primes=PRIMES) -> tuple[int, ...]:
    out = (0,) * len(primes)
    view = memoryview(data)
    for at in range(0, len(data), BLOCK):
        part = view[at : at + BLOCK]
        out = combine(out, block_hash(part, primes), len(part), primes)
    return out


def _packed(hashes: tuple[int, ...]) -> int:
    return hashes[0] << 31 | hashes[1]


def _hash_rows(primes, chunk: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps, sizes, shas = [], [], []
            for value in batch.column("text"):
                data = (value.as_py() or b"").lower()  # bytes.lower() changes A-Z only
                fps.append(_packed(fingerprint(data, primes)) if len(data) <= chunk else None)
                sizes.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], ["uid", "doc_id", "fp", "n_bytes", "text_sha256"])

    return run


def _hash_chunks(primes):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [(x.as_py() or b"").lower() for x in batch.column("bytes")]
            columns = [batch.column("uid"), batch.column("chunk"), pa.array([_packed(fingerprint(x, primes)) for x in parts], pa.int64()), pa.array([len(x) for x in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "chunk", "fp", "n"])

    return run


def _combine_chunks(primes):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                whole = (0,) * len(primes)
                for x in parts:
                    whole = combine(whole, (x["fp"] >> 31, x["fp"] & 2**31 - 1), x["n"], primes)
                out.append(_packed(whole))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(out, pa.int64())], ["uid", "fp"])

    return run


def _by_chunks(keyed: DataFrame, huge: DataFrame, primes, chunk: int) -> DataFrame:
    """(uid, fp) of the texts of ``huge`` (uid): their chunks are dealt over tasks and hashed there, and each text's chunk hashes are put in order and combined."""
    texts = keyed.select("uid", "text").join(huge.select("uid"), "uid", "left_semi")
    cut = texts.select("uid", "text", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int"))).alias("chunk"))
    cut = cut.select("uid", "chunk", F.expr(f"substring(text, chunk * {chunk} + 1, {chunk})").alias("bytes")).repartition("uid", "chunk")
    hashed = cut.mapInArrow(_hash_chunks(primes), "uid string, chunk int, fp long, n long")
    parts = hashed.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("chunk", "fp", "n"))).alias("parts"))
    return parts.mapInArrow(_combine_chunks(primes), "uid string, fp long")


def _stream_compare(batches):
    """Rows sorted by (group, block number, salt), the representative's first in each: hold that block, report who differs."""
    import pyarrow as pa

    key = held = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            now = (r["fp"], r["n_bytes"], r["split"], r["block"], r["salt"])
            if r["lead"]:
                key, held = now, r["bytes"].lower()
            elif now != key or r["bytes"].lower() != held:
                out.append(r["uid"])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["uid"])


def exact_dedup(docs: DataFrame, primes=PRIMES, per_salt: int = 100) -> DataFrame:
    """Groups of documents whose texts are equal after lower-casing A-Z; null counts as the empty text.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns for each row: doc_id, keep_id (the largest doc_id of
    the group), group_size, kept (true for exactly one row of a group, also where rows repeat), text_sha256.
    A null doc_id counts as smaller than all others; the empty table gives an empty result.

    1. Each task hashes its texts block by block and combines the block hashes by length-shifted arithmetic. The chunks of a huge text are hashed in tasks of their own
       and combined likewise.
    2. Groups are formed on (fingerprint, length), with a map-side combine; no text moves for it.
    3. Texts of groups of two or more move in blocks, keyed by group, block number and salt (a hot group is dealt over
       ``size / per_salt`` tasks, with a copy of its representative's block in each), and stream past the representative's block;
       a task holds one block. Those that differ, collisions, form a group of their own and are compared again until none is left.
    """
    keyed = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "uid").withColumn("text", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = materialize(keyed.select("uid", "doc_id", "text").mapInArrow(_hash_rows(primes, CHUNK), "uid string, doc_id long, fp long, n_bytes long, text_sha256 string"), "exact-rows")
    huge = rows.where("fp IS NULL")
    if not huge.isEmpty():
        whole = _by_chunks(keyed, huge, primes, CHUNK).withColumnRenamed("fp", "whole")
        before, rows = rows, materialize(rows.join(whole, "uid", "left").withColumn("fp", F.coalesce("fp", "whole")).drop("whole"), "exact-rows")
        release(before)
    group = ["fp", "n_bytes", "split"]
    rows = rows.withColumn("split", F.lit(0))
    while True:
        top = F.max(F.struct("doc_id", "uid"))
        groups = materialize(rows.groupBy(*group).agg(top.alias("top"), F.count("*").alias("group_size")).where("group_size > 1"), "exact-groups")
        wrong = _mismatches(keyed, rows.join(groups, group), per_salt)
        if wrong.isEmpty():
            break
        again = wrong.distinct().withColumn("again", F.lit(1))
        before = (groups, wrong)
        rows = materialize(rows.join(again, "uid", "left").withColumn("split", F.col("split") + F.coalesce("again", F.lit(0))).drop("again"), "exact-rows")
        release(*before)
    out = rows.join(groups, group, "left")
    alone = F.col("top").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("top.uid") == F.col("uid"))).alias("kept"), "text_sha256")


def _mismatches(keyed: DataFrame, members: DataFrame, per_salt: int) -> DataFrame:
    """The uid of those of ``members`` whose bytes differ from those of their group's representative, the one row of uid ``top.uid``."""
    salts = F.ceil(F.col("group_size") / per_salt).cast("int")
    group = ["fp", "n_bytes", "split"]
    lead = F.col("uid") == F.col("top.uid")
    dealt = F.when(lead, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("uid"), salts).cast("int")))
    texts = keyed.select("uid", "text").join(members.select("uid", *group, lead.alias("lead"), dealt.alias("salts")).hint("shuffle_hash"), "uid")
    blocks = texts.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_bytes") - 1) / BLOCK)).cast("int"))))
    blocks = blocks.select(*group, "block", F.explode("salts").alias("salt"), "lead", "uid", F.expr(f"substring(text, block * {BLOCK} + 1, {BLOCK})").alias("bytes"))
    dealt = blocks.repartition(*group, "block", "salt").sortWithinPartitions(*group, "block", "salt", F.desc("lead"))
    return materialize(dealt.mapInArrow(_stream_compare, "uid string"), "exact-wrong")
