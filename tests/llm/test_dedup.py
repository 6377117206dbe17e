"""Exact, near and line dedup against brute force, and on awkward rows."""

import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from txrisk.llm import exact_dedup, line_dedup, simhash
from txrisk.llm.components import connected_components
from txrisk.sources import scratch

DOCS = "doc_id long, text string, kept int, component_id string"
AWKWARD = [(1, "Same Text", 1, "x"), (2, "same text", 2, None), (3, None, None, None), (4, "", 0, "y"), (None, "same text", 1, "z"), (2, "same text", 2, None), (5, "ÄB", 1, "q"), (6, "äb", 1, "q")]


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def test_fingerprints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    whole = exact_dedup.fingerprint(data)
    for cut in (0, 1, 65536, 70_001, 199_999):
        a, b = data[:cut], data[cut:]
        assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == whole
    assert exact_dedup.fingerprint(b"\0") != exact_dedup.fingerprint(b"\0\0")
    p, b = exact_dedup.PRIMES[0], exact_dedup.BASES[0]
    assert exact_dedup.fingerprint(b"ab")[0] == (98 * b + 99) % p


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (2, 3)])
def test_exact_groups(spark, primes):
    """With two tiny primes most fingerprints collide, and the comparison has to tell the texts apart."""
    texts = ["alpha", "ALPHA", "omega", "gamma", "Gamma", "delta", "x" * 70_000 + "a", "x" * 70_000 + "b", "X" * 70_000 + "a", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df, primes=primes, per_salt=1).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.lower()].append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_awkward_rows(spark):
    out = exact_dedup.exact_dedup(spark.createDataFrame(AWKWARD, DOCS)).collect()
    assert len(out) == len(AWKWARD)
    by_text = Counter((r["keep_id"], r["group_size"]) for r in out)
    assert by_text == {(2, 4): 4, (4, 2): 2, (5, 1): 1, (6, 1): 1}
    assert sum(r["kept"] for r in out) == 4
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def brute_components(values, close):
    sets = Sets()
    for i, a in enumerate(values):
        sets.find(a)
        for b in values[:i]:
            if close(a, b):
                sets.join(a, b)
    return sets


def test_fingerprint_by_hand():
    import xxhash

    words = "the Quick brown fox".lower().encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 2)
    assert simhash.fingerprint_of("the Quick\tbrown\n fox") == want
    assert simhash.fingerprint_of("two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0


@pytest.mark.parametrize("wide", [simhash.WIDE, 3])
def test_links_against_all_pairs(spark, wide):
    """Balls of fingerprints a few bits around a centre, among random ones; also with every bucket counted as too wide."""
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values | {rng.getrandbits(64) for _ in range(200)})
    sets = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r["node"] % (1 << 64): r["component"] for r in connected_components(simhash.near_links(df, wide)).collect()}
    ours = defaultdict(set)
    for v in values:
        ours[found.get(v, v)].add(v)
    theirs = defaultdict(set)
    for v in values:
        theirs[sets.find(v)].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_every_close_pair_has_a_viable_chain():
    import numpy as np

    rng = random.Random(2)
    for _ in range(2000):
        x, y = rng.getrandbits(64), 0
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        assert any(len(simhash.chain_links(np.uint64(x), np.array([y], dtype=np.uint64), s)) for s in range(4))


def test_near_duplicates_awkward_rows(spark):
    out = simhash.near_duplicates(spark.createDataFrame(AWKWARD, DOCS)).collect()
    assert len(out) == len(AWKWARD)
    blank = [r for r in out if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in blank} == {3, 4} and {r["component_id"] for r in blank} == {3}
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2, None)} == {1}
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = simhash.keep_one(spark.createDataFrame(AWKWARD, DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6] and kept.columns == ["doc_id", "text", "kept", "component_id"]


def test_near_duplicates_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = simhash.near_duplicates(docs).collect()
    sets = brute_components(sorted({int(r["fingerprint"], 16) for r in out}), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for r in out:
        k = sets.find(int(r["fingerprint"], 16))
        first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == first[sets.find(int(r["fingerprint"], 16))] for r in out)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 440)] + [(5, 5), (None, 1)]
    sets = Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert set(got) == set(sets.up)
    assert all((got[a] == got[b]) == (sets.find(a) == sets.find(b)) for a in got for b in got)
    assert all(got[c] == c for c in got.values())
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def jaccard(a, b):
    s = lambda x: {x[i : i + line_dedup.SHINGLE] for i in range(len(x) - line_dedup.SHINGLE + 1)} or {x}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_line_dedup_of_documents(spark, small):
    """The lines of the smallest table against all pairs: verified links only, and nearly all of them."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").withColumn("uid", F.col("doc_id"))
    texts = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    out = line_dedup.near_lines(docs).collect()
    assert len(out) == sum(bool(x.strip()) for t in texts.values() for x in t)
    line = lambda r: texts[r["doc_id"]][r["line_no"]].strip().lower()
    values = sorted({line(r) for r in out})
    sizes = {v: len(v) for v in values}
    sets = brute_components(values, lambda a, b: min(sizes[a], sizes[b]) >= 0.5 * max(sizes[a], sizes[b]) and jaccard(a, b) >= line_dedup.SIMILARITY)
    ours = defaultdict(set)
    for r in out:
        ours[r["component"]].add(line(r))
    for group in ours.values():  # nothing is linked that isn't similar
        assert len({sets.find(v) for v in group}) == 1
    theirs = len({sets.find(v) for v in values})
    assert theirs <= len(ours) <= theirs + 0.02 * (len(values) - theirs) + 1
    for members in ours.values():
        kept = [r for r in out if line(r) in members and r["kept"]]
        assert len(kept) == 1 and (kept[0]["doc_id"], kept[0]["line_no"]) == min((r["doc_id"], r["line_no"]) for r in out if line(r) in members)


def test_line_dedup_rewrites_texts(spark):
    base = "a fairly long line about nothing in particular that goes on for quite a while and then stops"
    rows = [(2, f"{base}.\nown words here\n\nCommon", 9), (1, f"common\n  {base}!  ", 9), (3, None, 9), (4, "", 9), (5, f"{base}.", 9), (6, "短い行です短い行です", 9), (None, "common", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int").drop("uid").withColumn("left", F.lit(1))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()}
    assert out == {1: f"common\n  {base}!  ", 2: "own words here\n", 3: None, 4: "", 6: "短い行です短い行です"}
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_row_ids(spark, small, tmp_path):
    """Rows of files have the same id at each read; rows of other tables get one too."""
    import os

    from txrisk.llm.common import materialize, release, with_row_id

    path = f"{small}/documents.parquet"
    read = lambda: {r["row"]: r["doc_id"] for r in with_row_id(spark.read.parquet(path), "row").select("row", "doc_id").collect()}
    assert read() == read() and len(read()) == spark.read.parquet(path).count()
    made = with_row_id(spark.range(100).selectExpr("id AS doc_id", "'x' AS text"), "row")
    assert made.select("row").distinct().count() == 100
    written = materialize(spark.range(5), "gone")
    folder = written._scratch_path.removeprefix("file:")
    assert os.path.isdir(folder)
    release(written, written, spark.range(1))
    assert not os.path.exists(folder)


def test_line_places_agree_with_kept_rows(spark):
    """Rows that repeat, doc_id and all, keep a line once between them."""
    df = spark.createDataFrame([(7, "one line of some words that repeats"), (7, "one line of some words that repeats")], "doc_id long, text string")
    assert line_dedup.dedup(df).count() == 1


def shares_a_bucket(spark, pairs):
    """For each pair of lines, whether they are compared."""
    lines = sorted({x for p in pairs for x in p})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").withColumn("uid", F.col("doc_id"))
    kept = {r["doc_id"]: r["component"] for r in line_dedup.near_lines(docs).collect()}
    at = {x: i for i, x in enumerate(lines)}
    return [kept[at[a]] == kept[at[b]] for a, b in pairs]


def test_short_lines_by_number_of_words(spark):
    """Near copies of lines of each length, with a character changed or added, against their similarity."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 8)))
    by_words = defaultdict(list)
    for n in range(2, 10):
        while len(by_words[n]) < 40:
            a = " ".join(word() for _ in range(n))
            at = rng.randrange(len(a))
            b = rng.choice([a + ".", a[:-1] + "9", a[:at] + "9" + a[at:]])
            if jaccard(a, b) >= line_dedup.SIMILARITY:
                by_words[n].append((a, b))
    fixed = [("read this page", "read this page."), ("page number 1234", "page number 1235"), ("pneumonoultramicroscopicsilicovolcanoconiosis", "pneumonoultramicroscopicsilicovolcanoconiosi"), ("ภาษาไทยไม่มีช่องว่างระหว่างคำ", "ภาษาไทยไม่มีช่องว่างระหว่างคำๆ")]
    found = shares_a_bucket(spark, fixed + [p for n in by_words for p in by_words[n]])
    assert all(found[: len(fixed)])
    for i, n in enumerate(by_words):
        part = found[len(fixed) + 40 * i : len(fixed) + 40 * (i + 1)]
        assert sum(part) >= 39, (n, sum(part))


def test_candidates_share_a_band_and_half_of_the_bins(spark):
    """One equal band is enough as long as at most DIFFER bins differ."""
    n, rows = len(line_dedup.BANDS), []
    sketch = lambda differing: [sum(1 << 4 * i for i in range(12) if i < differing - 12 * half) for half in (0, 1)]
    for i, differing in [(1, 0), (2, line_dedup.DIFFER), (3, line_dedup.DIFFER + 1)]:
        rows.append((i, i, i, 1, False, 7, *[100 * i + j for j in range(n - 1)], *sketch(differing)))
    signed = spark.createDataFrame(rows, ", ".join(["id long", "h1 long", "h2 long", "n_lines long", "thin boolean", *[f"{b} long" for b in line_dedup.BANDS], "k1 long", "k2 long"]))
    pairs, crowd = line_dedup.candidates(signed)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (2, 3)] and crowd.count() == 0


def test_pairs_of_a_large_bucket_share_no_other(spark, monkeypatch):
    """Two lines that share one band only are met in a bucket of any size, also if neither is its first line."""
    n, k = len(line_dedup.BANDS), (1 << 48) - 1
    rows = [(i, i, i, 1, False, 7, *[100 * i + j for j in range(n - 1)], *((0, 0) if i in (3, 5) else (k // 15 * (2 * i + 1) % 2**48, k // 15 * (i + 1)))) for i in range(1, 7)]
    signed = spark.createDataFrame(rows, ", ".join(["id long", "h1 long", "h2 long", "n_lines long", "thin boolean", *[f"{b} long" for b in line_dedup.BANDS], "k1 long", "k2 long"]))
    alone = spark.createDataFrame([], "node long, component long")
    monkeypatch.setattr(line_dedup, "FEW", 2)
    for some in (6, 5):
        monkeypatch.setattr(line_dedup, "SOME", some)
        pairs, crowd = line_dedup.candidates(signed)
        mixed, crowded = line_dedup._mixed(crowd, alone)
        assert (3, 5) in {(r["a"], r["b"]) for r in pairs.select("a", "b").union(mixed).collect()} or {3, 5} <= {r["id"] for r in crowded.collect()}


def test_pipeline_links_lines_of_one_shared_band(spark, monkeypatch):
    """The pipeline's line stage drops a near copy that shares a single band with its like, were its bucket a large one."""
    import corpus_pipeline

    monkeypatch.setattr(line_dedup, "FEW", 1)
    rng, letters, lines = random.Random(8), "abcdefghijklmnopqrstuvwxyz", []
    while len(lines) < 2400:
        a = b = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(12))
        while (near := jaccard(a, c := edited(rng, b, letters))) >= line_dedup.SIMILARITY:
            b = c
        lines += [a, b]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").withColumn("uid", F.col("doc_id"))
    ids = {r["h1"]: r["doc_id"] for r in docs.select("doc_id", F.xxhash64("text").alias("h1")).collect()}
    signed = {ids[r["h1"]]: r for r in line_dedup.signatures(docs).collect()}
    shared = {i: sum(signed[i][b] == signed[i + 1][b] for b in line_dedup.BANDS) for i in range(0, len(lines), 2)}
    left = {r["doc_id"] for r in corpus_pipeline.lines(spark, docs.drop("uid"), "").collect()}
    one = [i for i, n in shared.items() if n == 1]
    assert one and set(range(0, len(lines), 2)) <= left and not {i + 1 for i in one} & left


def edited(rng, line, letters):
    at = rng.randrange(len(line))
    return rng.choice([line[:at] + rng.choice(letters) + line[at:], line[:at] + line[at + 1 :], line[:at] + rng.choice(letters) + line[at + 1 :]])


@pytest.mark.parametrize("kind", ["latin", "thai", "han", "token", "url", "long"])
def test_recall_by_kind_of_line(spark, kind):
    """Pairs of 0.8 and a little more by edits anywhere, in scripts without spaces and in long tokens too."""
    rng = random.Random(kind)
    letters = {"thai": "".join(map(chr, range(0x0E01, 0x0E2F))), "han": "".join(map(chr, range(0x4E00, 0x4F00)))}.get(kind, "abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    make = {
        "latin": lambda: " ".join(word() for _ in range(rng.randint(5, 40))), "thai": lambda: "".join(word() for _ in range(rng.randint(5, 40))), "han": lambda: "".join(word() for _ in range(rng.randint(5, 40))),
        "token": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(40, 200))), "url": lambda: "https://" + "/".join(word() for _ in range(rng.randint(5, 20))), "long": lambda: " ".join(word() for _ in range(1500)),
    }[kind]
    pairs = []
    while len(pairs) < (30 if kind == "long" else 300):
        a = b = make()
        while (near := jaccard(a, c := edited(rng, b, letters))) >= line_dedup.SIMILARITY and rng.random() > (0.001 if kind == "long" else 0.02):
            b = c
        if b != a:
            pairs.append((a, b))
    found = shares_a_bucket(spark, pairs)
    assert sum(found) >= 0.98 * len(pairs), sum(found) / len(pairs)


def test_thin_lines(spark):
    """Long lines of few different shingles, whose signatures are nearly empty, are compared all the same; so are they of different lengths."""
    pairs = [("-" * 3000, "-" * 2000), ("ab " * 900, "ab " * 700), ("=+" * 500 + "end", "=+" * 800 + "end"), ("long and dull " * 60, "long and dull " * 90)]
    assert all(shares_a_bucket(spark, pairs)) and not any(shares_a_bucket(spark, [("-" * 3000, "=" * 3000), ("ab " * 900, "ac " * 900)]))


@pytest.mark.parametrize("n, many", [(150, line_dedup.MANY), (1500, line_dedup.MANY), (150, 20)])
def test_lines_of_one_template(spark, monkeypatch, n, many):
    """Pairs of near copies among lines that share a long passage, at two sizes; also with every shingle counted as hot."""
    monkeypatch.setattr(line_dedup, "MANY", many)
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 7)))
    passage = " ".join(word() for _ in range(12))
    pairs = []
    while len(pairs) < n:
        a = passage + " " + " ".join(word() for _ in range(3))
        at = len(passage) + rng.randint(2, 12)
        b = a[:at] + "9" + a[at + 1 :]
        if jaccard(a, b) >= line_dedup.SIMILARITY:
            pairs.append((a, b))
    assert all(shares_a_bucket(spark, pairs))


def test_crowded_lines_against_all_pairs(spark, monkeypatch):
    """Lines of a passage with own parts of all lengths, with every bucket counted as crowded and every shingle as hot or none."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage, own = [word() for _ in range(16)], [word() for _ in range(12)]
    lines = sorted({" ".join(passage[rng.randint(0, 4) :] + [rng.choice(own) for _ in range(rng.randint(0, 5))]) for _ in range(260)})
    sets = brute_components(lines, lambda a, b: jaccard(a, b) >= line_dedup.SIMILARITY)
    want = len({sets.find(v) for v in lines})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").withColumn("uid", F.col("doc_id"))
    for few, many in ((1, 10**9), (1, 1)):
        monkeypatch.setattr(line_dedup, "FEW", few)
        monkeypatch.setattr(line_dedup, "SOME", few)
        monkeypatch.setattr(line_dedup, "MANY", many)
        got = defaultdict(set)
        for r in line_dedup.near_lines(docs).collect():
            got[r["component"]].add(lines[r["doc_id"]])
        assert len(got) == want and all(len({sets.find(v) for v in g}) == 1 for g in got.values())


def test_row_ids_of_made_up_rows(spark, tmp_path):
    """An explode, a join and a union of one scan repeat its rows: each has an id of its own, and no text is lost."""
    from txrisk.llm import mixing
    from txrisk.llm.common import with_row_id

    spark.createDataFrame([(1, "line one of some length"), (2, "line two is another one")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    scan = spark.read.parquet(str(tmp_path / "d"))
    exploded = scan.select("doc_id", F.explode(F.array("text", F.concat("text", F.lit(" and a tail of its own that goes on")))).alias("text"))
    joined = scan.join(spark.createDataFrame([(2, "x"), (2, "y")], "doc_id long, more string"), "doc_id", "left").select("doc_id", F.concat_ws(" ", "text", F.repeat("more", F.lit(40))).alias("text"))
    for df in (exploded, joined, scan.union(exploded), scan.where("doc_id = 2").union(joined)):
        ids = [r["row"] for r in with_row_id(df, "row").collect()]
        assert len(ids) == len(set(ids)) == df.count()
        texts = {r["text"] for r in df.collect()}
        assert {r["text"] for r in line_dedup.dedup(df).collect()} == texts
        assert {r["text"] for r in simhash.keep_one(df).collect()} == texts
        copies = df.withColumns({"lang": F.lit("en"), "source": F.lit("s1")})
        assert {r["text"] for r in mixing.mix_documents(copies, seed=1).collect()} == texts


def test_exact_dedup_of_many_equal_rows(spark):
    """Rows that repeat, doc_id and text, cost their number and not its square."""
    import time

    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    began = time.time()
    out = exact_dedup.exact_dedup(rows).agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.min("group_size").alias("size")).first()
    assert (out["n"], out["kept"], out["size"]) == (50_000, 1, 50_000) and time.time() - began < 60


def test_kept_hashes_decide_as_all_shingles_do(spark):
    """Pairs are linked exactly where all their shingles say so, short lines and long ones."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij\U0001f600é") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(300):
        a = [word() for _ in range(rng.randint(1, 80))]
        b = [w if rng.random() > rng.choice((0.0, 0.05, 0.1, 0.3, 0.9)) else word() for w in a] * rng.choice((1, 1, 1, 3))
        rows.append((2 * i, " ".join(a), 2 * i + 1, " ".join(b)))
    texts = spark.createDataFrame([x for a, s, b, t in rows for x in ((a, s), (b, t))], "id long, line string")
    pairs = spark.createDataFrame([(a, b) for a, _, b, _ in rows], "a long, b long")
    found = {r["src"] for r in line_dedup.linked(pairs, line_dedup.kept_hashes(texts), texts).collect()}
    assert found == {a for a, s, _, t in rows if jaccard(s, t) >= line_dedup.SIMILARITY} and any(len(t) > 2 * line_dedup.KEPT for *_, t in rows)


def test_files_listed_twice(spark, tmp_path):
    """Rows of a file that a scan lists twice are rows of their own for every operator that knows rows by ids."""
    from txrisk.llm import mixing
    from txrisk.llm.common import with_row_id

    path = str(tmp_path / "docs" / "part")
    rows = [(1, "one line of some words that stays here\nand another line of other words", "en", "s1"), (2, "a text of its own with words enough", "en", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    twice = spark.read.parquet(path, path)
    assert twice.count() == 4 and with_row_id(twice, "id").select("id").distinct().count() == 4
    assert line_dedup.dedup(twice).count() == 2 and simhash.keep_one(twice).count() == 2
    assert exact_dedup.exact_dedup(twice).where("kept").count() == 2
    assert mixing.mix_documents(twice, max_epochs=1).count() == 4
    nested = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "docs"), path)
    assert with_row_id(nested, "id").select("id").distinct().count() == nested.count()
    assert with_row_id(spark.read.parquet(path), "id").select("id").distinct().count() == 2


def test_huge_texts_are_hashed_by_chunks(spark, monkeypatch):
    """Chunks of a text hashed in tasks of their own combine to the fingerprint of the whole."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcDEFé ") for _ in range(n))) for i, n in enumerate((0, 1, 300, 3000, 9001))] + [(9, None)]
    docs = spark.createDataFrame(rows + [(r[0] + 20, r[1]) for r in rows], "doc_id long, text string")
    key = lambda r: r["doc_id"]
    want = sorted(exact_dedup.exact_dedup(docs).collect(), key=key)
    monkeypatch.setattr(exact_dedup, "CHUNK", 256)
    assert sorted(exact_dedup.exact_dedup(docs).collect(), key=key) == want


def words_line(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 7))) for _ in range(n))


def test_fingerprints_rule_out_no_near_copy(spark):
    """What fingerprints rule out is less than similar, at any length; nearly all that is far from similar is ruled out, and what is left is told exactly."""
    rng, lines = random.Random(21), []
    for i in range(120):
        a = b = words_line(rng, rng.choice([3, 10, 60, 150]))
        for _ in range(rng.randint(1, max(2, len(a) // 12))):
            b = edited(rng, b, "abcdefghijklmnopqrstuvwxyz")
        lines += [a, b]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(lines), 2)], "a long, b long")
    left = line_dedup.possible(pairs, line_dedup.fingerprints(texts))
    near = {i: jaccard(lines[i], lines[i + 1]) for i in range(0, len(lines), 2)}
    ids = {r["a"] for r in left.collect()}
    alike = {i for i, x in near.items() if x >= line_dedup.SIMILARITY}
    assert 20 < len(alike) < 100 and alike <= ids and not ids & {i for i, x in near.items() if x < 0.6}
    assert {r["a"] for r in line_dedup.verified(left, texts).collect()} == alike


def test_signatures_are_compiled(spark, small, monkeypatch):
    """No method that Spark generates for signatures is over the 8,000 bytes beyond which the JVM doesn't compile it."""
    plans = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: plans.append(df) or df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        line_dedup.signatures(spark.read.parquet(f"{small}/documents.parquet"))
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plans[0]._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and 0 < max(sizes) < 8000


def test_blanks_at_the_ends_of_lines(spark):
    """Each kind of blank at either end is cut, blanks inside stay, and a line of blanks is none."""
    text = "\n".join([f"{x}One  line{y}" for x in ["", *line_dedup.EDGES] for y in ["", *line_dedup.EDGES]] + ["", *line_dedup.EDGES, line_dedup.EDGES])
    rows = line_dedup._lines(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert len(rows) == 36 and {r["line"] for r in rows} == {"one  line"} and len({(r["h1"], r["h2"]) for r in rows}) == 1


def test_fingerprints_are_compiled(spark, monkeypatch):
    """Shingles are dealt out in generated code: a lambda inside explode would keep Spark from compiling it."""
    plans = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, **_: plans.append(df) or df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        line_dedup.fingerprints(spark.createDataFrame([(1, "a line of some words")], "id long, line string"))
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    steps = [x for x in plan.splitlines() if "Generate explode" in x]
    assert steps and all("*(" in x.split("Generate")[0] for x in steps)


def test_texts_are_cut_into_lines_twice(spark, monkeypatch):
    """Once to sign the lines and once for their places and the texts to compare, with equal, near, lone and blank lines told apart."""
    calls, cut = [], line_dedup._lines
    monkeypatch.setattr(line_dedup, "_lines", lambda *a: calls.append(a) or cut(*a))
    near = "a fairly long line about nothing in particular that goes on for quite a while"
    rows = [(2, f"{near}!\nequal\n\nalone"), (1, f"equal\n{near}"), (3, None), (4, "Equal ")]
    out = line_dedup.near_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.col("doc_id"))).collect()
    assert len(calls) == 2
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"], r["kept"]) for r in out}
    assert got == {(1, 0): (1, 0, True), (1, 1): (1, 1, True), (2, 0): (1, 1, False), (2, 1): (1, 0, False), (2, 3): (2, 3, True), (4, 0): (1, 0, False)} and len(out) == len(got)


def _shuffled(spark):
    """The shuffle files there are; a deleted table's may take a moment to go."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(str(d)).rglob("shuffle_*")}


def _gone(spark, before):
    for _ in range(50):
        if not (left := _shuffled(spark) - before):
            break
        time.sleep(0.1)
    return not left


def test_a_written_tables_shuffles_are_deleted(spark):
    """At once, not when the driver collects its garbage; the session's setting stays as it was, after an error too."""
    before = _shuffled(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count()
    setting = spark.conf.get(scratch.SHUFFLES_GO, None)
    out = scratch.materialize(counts, "counts")
    assert _gone(spark, before) and spark.conf.get(scratch.SHUFFLES_GO, None) == setting
    assert sorted(r["count"] for r in out.collect()) == sorted(r["count"] for r in counts.collect()) == [142] + [143] * 5 + [143]
    with pytest.raises(Exception, match="broken"):
        scratch.materialize(counts.select(F.raise_error(F.lit("broken")).alias("x")), "broken")
    assert spark.conf.get(scratch.SHUFFLES_GO, None) == setting


def test_line_dedup_leaves_no_shuffles_and_few_tables(spark, monkeypatch):
    """While texts are dealt to their places, neither shuffles of the steps before nor the signatures lie on disk."""
    seen, write = {}, line_dedup.materialize
    scratch_ = Path(scratch.scratch_dir(spark))
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: seen.setdefault(name, (_gone(spark, before), mine())) and write(df, name))
    mine = lambda: {p.name[:-33] for p in scratch_.iterdir()} - there
    before, there = _shuffled(spark), {p.name[:-33] for p in scratch_.iterdir()}
    near = "a fairly long line about nothing in particular that goes on for quite a while"
    docs = spark.createDataFrame([(i, f"{near}{'!' * (i % 3)}\nline {i}") for i in range(20)], "doc_id long, text string").withColumn("uid", F.col("doc_id"))
    out = line_dedup.near_lines(docs)
    assert all(gone for gone, _ in seen.values()) and _gone(spark, before)
    assert "line-signatures" in seen["line-members"][1] and "line-signatures" not in seen["line-places"][1]
    assert out.where("kept").count() == 21


def test_the_pipeline_keeps_no_table_that_is_read(spark, small, monkeypatch):
    """A stage's table goes when the next one's is written, and what line dedup reads its lines from goes before texts are dealt to their lines."""
    import corpus_pipeline

    folder, seen, write = Path(scratch.scratch_dir(spark)), {}, corpus_pipeline.materialize
    there = set(folder.iterdir())
    new = lambda: {p.name[:-33] for p in set(folder.iterdir()) - there}
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name: seen.setdefault(name, new()) and None or write(df, name))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda s, docs, d: docs), ("line_dedup", corpus_pipeline.lines)])
    out = corpus_pipeline.run(spark, small)
    assert "line-gone" in seen["pipeline-line_dedup"] and not seen["pipeline-line_dedup"] & {"line-places", "line-classes", "line-firsts", "line-signatures"}
    assert "pipeline-line_dedup" in new() and "pipeline-first" not in new()
    assert 0 < out.count() <= spark.read.parquet(f"{small}/documents.parquet").count()
