"""SimHash near-duplicates, linked through pigeonring filtering."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialize, release, with_row_id
from .components import connected_components

#: A fingerprint is a ring of four segments of 16 bits, the first at the high end. With at most 3 differing bits on the ring some
#: segment starts a chain whose first 1, 2, 3, 4 segments differ in at most 0, 1, 2, 3 bits: 3/4 of a bit for each segment.
SEGMENTS, BITS, LIMIT = 4, 16, 3
#: Buckets of more distinct fingerprints than this are dealt out again under a longer key.
WIDE = 50_000


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text; see ``fingerprints``."""
    import numpy as np
    import xxhash

    words = re.findall(WORD_BYTES, (text or "").encode().lower())
    if not words:
        return 0
    data, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(data, seed)]
    else:
        starts = [0] * (n + 1)
        at = 0
        for i, w in enumerate(words, 1):
            at += len(w) + 1
            starts[i] = at
        hashes = [digest(data[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])]
    ones = np.zeros(64, dtype=np.int64)
    column = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(column), 1 << 14):
        ones += np.unpackbits(column[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [f - (1 << 64) if (f := fingerprint_of(t.as_py(), shingle, seed)) >> 63 else f for t in batch.column("text")]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(fps, pa.int64())], [*rest, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, row_id: str | None = None) -> DataFrame:
    """(doc_id, fp), and a text column ``row_id`` if one is named: fp is the signed value of the 64 bits. Texts are lower-cased in A-Z; shingles of ``shingle`` words joined by one
    space, repeats included, are hashed by XXH64; a bit is 1 if it is set in over half of them. Fewer words than that: the whole
    sequence is the one shingle; no word or null: 0."""
    more = [row_id] if row_id else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text").mapInArrow(_fingerprint_batches(shingle, seed), ", ".join(["doc_id long", *[f"{c} string" for c in more], "fp long"]))


def _segment(i: int):
    return F.shiftrightunsigned(F.col("fp"), BITS * (SEGMENTS - 1 - i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _keys(depth: int):
    """For each start of a chain, and each way to split the further segments into one part more than their budget: the bits that
    two fingerprints with such a chain share in at least one of the ways. Depth 2: 8 keys of 24 bits, 3: 24 of 29, 4: 96 of 33."""
    out = []
    for start in range(SEGMENTS):
        ways = [(f"{start}", [_segment(start)])]
        for step in range(1, depth):
            parts = step + 1
            edges = [BITS * k // parts for k in range(parts + 1)]
            ways = [(f"{name}.{k}", [*bits, F.shiftright(_segment(start + step), edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1).cast("long"))]) for name, bits in ways for k in range(parts)]
        out += [F.struct(F.lit(start).alias("start"), F.xxhash64(F.lit(name), *bits).alias("key")) for name, bits in ways]
    return F.explode(F.array(*out))


def _masks(start: int) -> list[int]:
    """For chains of 2, 3 and 4 segments from ``start``: their bits."""
    one = [((1 << BITS) - 1) << BITS * (SEGMENTS - 1 - (start + j) % SEGMENTS) for j in range(SEGMENTS)]
    return [sum(one[:n]) for n in range(2, SEGMENTS + 1)]


def chain_links(x, ys, start: int):
    """Which of ``ys`` are within LIMIT bits of x by a viable chain from ``start``: budgets for growing chains first, the full
    Hamming distance last, each for those that passed the one before."""
    import numpy as np

    left = np.arange(len(ys))
    diff = ys ^ x
    for budget, mask in enumerate(_masks(start), 1):
        ok = np.bitwise_count(diff & np.uint64(mask)) <= budget
        left, diff = left[ok], diff[ok]
    return left


def _bucket_links(fps, start: int):
    """Spanning links of one bucket of distinct fingerprints: search from one fingerprint on, always among those not reached yet.
    In a dense bucket most are reached at once, in a sparse one there are few; in neither are all pairs written."""
    import numpy as np

    rest, out = np.asarray(fps, dtype=np.uint64), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            if len(hit := chain_links(x, rest, start)):
                out += [(x, y) for y in rest[hit]]
                queue += list(rest[hit])
                rest = np.delete(rest, hit)
    return out


def _link_batches(batches):
    """Rows (start, key, fp) sorted by start and key. Buckets of one are skipped; the last of a batch waits for the next."""
    import numpy as np
    import pyarrow as pa

    held = None

    def links(start, key, fp, last):
        edge = np.flatnonzero((key[1:] != key[:-1]) | (start[1:] != start[:-1])) + 1
        cuts = np.concatenate(([0], edge, [len(key)]))
        whole = len(cuts) - 1 if last else len(cuts) - 2
        out = []
        for i in np.flatnonzero(np.diff(cuts[: whole + 1]) > 1):
            out += _bucket_links(fp[cuts[i] : cuts[i + 1]], int(start[cuts[i]]))
        return out, cuts[whole]

    def table(out):
        a = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["src", "dst"])

    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if not len(held[0]):
            continue
        out, at = links(*held, False)
        held = [x[at:] for x in held]
        yield table(out)
    if held is not None and len(held[0]):
        yield table(links(*held, True)[0])


def near_links(fps: DataFrame, wide: int = WIDE) -> DataFrame:
    """Links (src, dst) between distinct fingerprints ``fp`` at most LIMIT bits apart that have the same components as all such links.

    A fingerprint goes to 8 buckets, under 24 bits that a viable chain of two segments fixes. Buckets of more than ``wide``, if any,
    go to 12 times as many under 33 bits that a chain of four fixes, so a hot bucket is dealt out without losing a link."""
    keyed = fps.select("fp", _keys(2).alias("k")).select(F.col("k.start").alias("start"), F.col("k.key").alias("key"), "fp")
    sizes = keyed.groupBy("start", "key").count().where(F.col("count") > 1)
    hot = materialize(sizes.where(F.col("count") > wide).select("start", "key"), "simhash-wide")

    def linked(rows):
        return rows.repartition("start", "key").sortWithinPartitions("start", "key").mapInArrow(_link_batches, "src long, dst long")

    if hot.isEmpty():
        return linked(keyed)
    deep = keyed.join(hot, ["start", "key"]).select("fp").distinct()
    deep = deep.select("fp", _keys(4).alias("k")).select(F.col("k.start").alias("start"), F.col("k.key").alias("key"), "fp")
    return linked(keyed.join(hot, ["start", "key"], "left_anti")).union(linked(deep))


def classes(rows: DataFrame, first, wide: int = WIDE) -> DataFrame:
    """(fp, first) for each fingerprint of ``rows``, where ``first`` is this minimum over all rows of the fingerprint's class."""
    firsts = materialize(rows.groupBy("fp").agg(first.alias("first")), "simhash-fps")
    links = materialize(near_links(firsts.select("fp"), wide), "simhash-links")
    found = connected_components(links)
    named = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    out = materialize(named.join(least, "component").select("fp", F.col("least").alias("first")), "simhash-classes")
    release(firsts, links, found)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, wide: int = WIDE) -> DataFrame:
    """Classes of documents whose SimHash fingerprints are linked by chains of steps of at most 3 bits.

    ``docs`` has doc_id and text; other columns are ignored. Returns for each row: doc_id, fingerprint (16 hex digits), component_id
    (the smallest doc_id of the class; null doc_ids don't count, a class of none but these has null). Null and blank texts have
    fingerprint 0 and are linked like any other. Repeated rows are returned as often as they come; an empty table gives none.

    Copies collapse into one fingerprint by a map-side combine before anything is compared."""
    rows = materialize(fingerprints(docs, shingle, seed), "simhash-rows")
    of_fp = classes(rows, F.min("doc_id"), wide).withColumnRenamed("first", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, seed: int = 42, wide: int = WIDE) -> DataFrame:
    """``docs`` with one row of each class: the first by doc_id, null last, and of rows that repeat it one. All columns stay."""
    known = with_row_id(docs.select(F.struct("*").alias("__doc")), "__row")
    rows = materialize(fingerprints(known.select("__doc.doc_id", "__doc.text", "__row"), shingle, seed, "__row"), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    first = classes(rows, F.min(order), wide).select(F.col("first.__row").alias("__row")).distinct()
    return known.join(first, "__row", "left_semi").select("__doc.*")
