"""Manifest, sharding and resampling against brute force, with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from txrisk.llm import interning, manifest, queries, resampling, sharding

ROWS = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [(1, "s", "en", 3, "A b c"), (1, "s", "en", 3, "A b c"), (None, None, None, None, None), (None, "s", None, 1, ""), (4, "", "de", 0, " \t\n"), (4, "ö", "de", 0, "Straße ÄÖ 12a"), (5, "s", None, None, None)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows, fanout):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(c.lower() if c.isascii() else c for c in t)

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                run = a // fanout * fanout
                paths[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + fanout])))
            nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
            at = [a // fanout for a in at]
        return nodes[0], paths

    parts = []
    for source in sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(((r[0], sha("".join(map(value, r))), sha("".join(map(value, [*r[:4], lower(r[4])])))) for r in rows if r[1] == source), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        parts.append((leaves, *tree([x[1] for x in leaves])))
    root, upper = tree([p[1] for p in parts])
    out = []
    for (leaves, subroot, paths), up in zip(parts, upper):
        for (doc, leaf, forged), path in zip(leaves, paths):
            now = forged if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 else leaf
            for a, b in path + up:
                now = sha(a + now + b)
            out.append((doc, leaf, subroot, root, sha("".join(a + b for a, b in path + up)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout, levels, sources, n", [(2, 1, 5, 60), (3, 1, 1, 50), (3, 2, 11, 150)])
def test_manifest_by_brute_force(spark, fanout, levels, sources, n):
    rng = random.Random(n)
    rows = ODD + [(rng.choice([None, *range(40)]), rng.choice([None, "hot", "hot", *[f"s{k}" for k in range(sources)]]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Ab ö\nC", "x Y"])) for _ in range(n)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS leaf", "2 AS at", "3 AS node", "4 AS block")
    struck = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    forged = F.when(struck, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = manifest.manifest(docs, tampered={"text": forged}, fanout=fanout, levels=levels)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows, fanout)


def test_manifest_of_one_and_of_none(spark):
    docs = spark.createDataFrame(ODD[:1], ROWS)
    (one,) = manifest.manifest(docs).collect()
    assert one["root"] == one["subroot"] == one["leaf"] == one["folded_root"] and one["proof_sha256"] == sha("") and one["verified"]
    assert manifest.manifest(docs.limit(0)).count() == 0


def least_capacity(sizes, shards):
    def fits(c):
        n, now = 1, 0
        for x in sizes:
            n, now = (n + 1, x) if now + x > c else (n, now + x)
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("cells", [4, 64, 100_000])
def test_least_capacity(monkeypatch, cells):
    """Whatever little a pass shows, the capacity is the least there is, and every cut is the end of a group."""
    rng = random.Random(cells)
    for _ in range(25):
        sizes = [rng.choice([rng.randint(8, 20), rng.randint(8, 900)]) for _ in range(rng.randint(1, 200))]
        ends, shards = list(itertools.accumulate(sizes)), rng.randint(1, 24)

        def seen(_, ranges, ends=ends):
            per, out = max(2, cells // len(ranges)), {}
            for i, (a, b) in enumerate(ranges):
                for e in ends:
                    if a < e <= b:
                        out.setdefault((i, (e - a - 1) // -(-(b - a) // per)), []).append(e)
            return [(min(v), max(v), len(v)) for v in out.values()]

        monkeypatch.setattr(sharding, "_cells", seen)
        cuts = sharding.cuts_of(None, ends[-1], max(sizes), shards)
        assert len(cuts) == shards and cuts == sorted(cuts) and set(cuts) <= {0, *ends}
        assert max(b - a for a, b in zip([0, *cuts], cuts)) == least_capacity(sizes, shards)


def check_shards(rows, out, shards):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    assert len(out) == len(rows) and all(r["law"] == "bytes" and 0 <= r["shard"] < shards and r["grown_shard"] is None for r in out)
    where = {}
    for r in out:
        where.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in where.values())
    return where


def test_sharding_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 16)
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice([f"text {rng.randint(0, 80)}", "x" * rng.randint(0, 60), None, "", "ö" * rng.randint(1, 9)])) for i in range(400)] + [(900 + i, "copy " * 400) for i in range(9)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS size", "3 AS slot")
    out = sharding.shard_texts(docs, 7).collect()
    where = check_shards(rows, out, 7)
    group = {}  # equal texts as (first doc_id, bytes)
    for d, t in rows:
        g = group.setdefault(t or "", [10**9, 0])
        g[0], g[1] = min(g[0], 10**9 if d is None else d), g[1] + len((t or "").encode()) + 8
    total, giant = sum(g[1] for g in group.values()), group["copy " * 400][1]
    assert giant > total / 7 and {r["shard"] for r in out if r["size"] == 2008} == {0} and len(where[0]) == 18
    assert group[""][1] > (total - giant) / 6 and {r["shard"] for r in out if r["size"] == 8} == {1}  # the second largest, of null and empty texts
    rest = [b for t, (_, b) in sorted(group.items(), key=lambda x: x[1][0]) if t not in ("", "copy " * 400)]
    texts = {d: t or "" for d, t in rows if d is not None}
    homes = {}
    for r in out:
        if r["doc_id"] is not None:
            homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    assert max(sum(r["size"] for r in v) for s, v in where.items() if s > 1) == least_capacity(rest, 5)


def test_sharding_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, ""), (4, "b" * 5000)], "doc_id long, text string")
    where = check_shards([(1, "a"), (1, "a"), (2, None), (3, ""), (4, "b" * 5000)], sharding.shard_texts(docs).collect(), 24)
    assert sorted(sorted(r["doc_id"] for r in v) for v in where.values()) == [[1, 1], [2, 3], [4]]
    assert sharding.shard_texts(docs.limit(0)).count() == 0


def test_sharding_of_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(docs, queries.op12_sharding(spark, small).collect(), 24)


def test_interning():
    """Hashes are XXH64, and equal bytes have one slot under any hashes, all equal ones too."""
    rng = random.Random(3)
    words = [rng.randbytes(rng.randrange(50)) for _ in range(500)] * 2
    data, n = np.frombuffer(b"".join(words) + bytes(32), dtype=np.uint8), np.array([len(w) for w in words])
    at = np.cumsum(n) - n
    hashes = interning.xxh64(data, at, n)
    assert hashes.tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    for h in (hashes, hashes % np.uint64(3), hashes * np.uint64(0)):
        slots, owner = interning.intern(data, at, n, h)
        pairs = set(zip(words, slots.tolist()))
        assert len(pairs) == len(set(words)) == len({s for _, s in pairs}) == (owner >= 0).sum()


def brute_resample(docs, target, ngrams, buckets=10_000, percent=10, least=20):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    def features(t):
        w = words(t)
        return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for d, x in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"2024:{'' if d is None else d}")[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit):
        r[4] = i + 1 if i < len(fit) * percent // 100 else None
    return sorted(((*r[:4], r[4] or None) for r in out), key=str)


@pytest.mark.parametrize("ngrams, piece", [((1, 1), 1 << 22), ((1, 1), 100), ((1, 3), 1 << 22), ((2, 3), 100)])
def test_resampling_by_brute_force(spark, monkeypatch, ngrams, piece):
    """Short pieces cut long texts into many, at other places than between texts."""
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = random.Random(9)
    some = ["The", "cat", "ZEBRA", "9x", "größe", "Ärger", "a-b", "日本 語", "x" * 40, "it's", "\x7f", "..."]
    docs = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(some) for _ in range(rng.randint(15, 90)))) for i in range(120)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, None), (501, ""), (502, " .,\n"), (503, " ".join(rng.choice(some) for _ in range(4000))), (504, "y" * 900)]
    target = ["the cat", None, "zebra größe the cat " * 5]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS weight", "2 AS score", "3 AS id")
    got = resampling.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), ngrams=ngrams)
    want = brute_resample(docs, target, ngrams)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    mine = sorted(map(tuple, got.collect()), key=str)
    assert [r[:4] for r in mine] == [r[:4] for r in want] and sorted(r[4] or 0 for r in mine) == sorted(r[4] or 0 for r in want)
    assert resampling.resample(table.limit(0), table.limit(0)).count() == 0


def test_resampling_moves_towards_the_target(spark, small):
    out = queries.op13_resampling(spark, small).agg(F.avg("weight"), F.avg(F.when(F.col("rank").isNotNull(), F.col("weight")))).first()
    assert out[1] > out[0]
