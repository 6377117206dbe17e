"""Classifiers by held-out accuracy, pieces by round trips and against the tokenizer's own encoder."""

import random

import pytest
from pyspark.sql import functions as F

from txrisk.llm import language_id, pieces, quality_model, queries

TEXTS = ["", "a", "  two  spaces ", "tabs\tand\nlines", "▁already ▁there▁", "日本語のテスト 🤦🏼", "ünïcödé straße", "x" * 300, " ", "0123456789 " * 30, "<s> </s> <unk> <0x41>"]


@pytest.fixture(scope="module")
def path():
    return queries.model_path()


def ids_of(blob):
    import numpy as np

    return np.frombuffer(blob, "<u2").tolist()


def test_without_dropout_it_is_the_models_own(path, spark, small):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in TEXTS if "▁" not in t] + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()]
    for t, blob in zip(texts, pieces.Encoder(path, 0.0, 1, 4).encode(texts, list(range(len(texts))))):
        assert ids_of(blob) == own.encode(t), t[:60]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_decodes_to_the_text(path, dropout):
    m = pieces.model(path)
    out = pieces.Encoder(path, dropout, 3, 2).encode(TEXTS, list(range(len(TEXTS))))
    assert [pieces.decode_ids(m, ids_of(x)) if x else "" for x in out] == TEXTS


def test_agenda_and_steps_agree(path):
    m, rng = pieces.model(path), random.Random(5)
    words = [" " * rng.randint(1, 3) + "".join(rng.choice("thereandion▁é日") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for p in (0.0, 0.2, 0.9):
        limit = int(p * 2**64)
        keys = [pieces.chunk_key(w, 1, 9) for w in words]
        assert pieces.in_step(m, words, keys, limit) == [pieces.by_agenda(m, w, k, limit) for w, k in zip(words, keys)]


def test_seeds_vary_and_repeat(path):
    text = ["the quick brown fox jumps over the lazy dog and runs away into the forest"]
    enc = lambda seed, name: pieces.Encoder(path, 0.3, seed, 50).encode(text, [name])[0]
    assert enc(1, "a") == enc(1, "a") and len({enc(s, "a") for s in range(10)}) > 5 and len({enc(1, n) for n in range(10)}) > 5


def test_occurrences_and_documents_vary(path):
    """A word that comes often has many segmentations, also within one document; each is what its merges give one by one."""
    m, word = pieces.model(path), "international"
    enc = pieces.Encoder(path, 0.3, 1)
    texts = [" ".join([word] * 200)] * 6
    blobs = enc.encode(texts, list(range(6)))
    assert len(set(blobs)) == 6 and blobs == pieces.Encoder(path, 0.3, 1).encode(texts, list(range(6)))
    assert [enc.encode([t], [i])[0] for i, t in enumerate(texts)] == blobs
    one, forms, at = ids_of(blobs[0]), set(), []
    for i in one:
        if m.pieces[i].startswith("▁") and at:
            forms.add(tuple(at))
            at = []
        at.append(i)
    assert len(forms) > 10
    import numpy as np

    keys = pieces._mix(np.uint64(enc.key(0)) + pieces._mix(np.arange(200, dtype=np.uint64)))
    assert blobs[0] == b"".join(pieces.by_agenda(m, " " + word, int(k), enc.limit) for k in keys)


def test_copies_of_a_document_vary(spark, path):
    text = "the quick brown fox jumps over the lazy dog and runs away into the forest " * 5
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    out = pieces.encode_copies(df, path)
    assert out.columns == ["doc_id", "ids"]
    assert len({str(r["ids"]) for r in out.collect()}) == 5
    assert sorted(map(str, pieces.decode(out, path).collect())) == sorted(map(str, df.collect()))


def test_pieces_as_tables(spark, path):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(99, None, "old"), (None, "null id", "old"), (1, "a", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(df, path)
    assert out.columns == ["doc_id", "ids"]
    back = pieces.decode(out, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("doc_id", "text").collect()))
    d = {r["doc_id"]: r for r in pieces.digest(df, path).collect()}
    assert d[99]["n_pieces"] is None and d[99]["lossless"] is None and all(r["lossless"] for k, r in d.items() if k != 99)
    assert pieces.digest(df.limit(0), path).count() == 0


def test_codewords():
    for n in (1, 2, 4, 30):
        m = language_id.codewords(n)
        assert m.shape[0] == n and all((m[i] != m[j]).sum() >= min(3, n - 1) for i in range(n) for j in range(i))
        ways = {tuple(c * c[0]) for c in m.T.tolist() for c in [__import__("numpy").array(c)]}
        assert len(ways) == m.shape[1]  # no two bits part the classes alike
    assert language_id.codewords(4).shape[1] == 7


def test_bits_are_weighed_by_class():
    """A bit that is never right on a class doesn't outvote the others there."""
    import numpy as np

    code = language_id.codewords(4)
    margins = code[2:3] * 1.0
    margins[:, :3] *= -6  # three bits are wrong, and loud
    trust = np.ones(code.shape)
    trust[2, :3] = 0.01
    trust *= code.shape[1] / trust.sum(axis=1, keepdims=True)
    assert language_id.decode(margins, code)[0][0] != 2 and language_id.decode(margins, code, trust)[0][0] == 2


def test_every_language_is_learnt(spark):
    """230 languages, each of its own letters; one doc_id that comes 500 times is one row of the sample."""
    rows = [(i * 10 + k, " ".join(chr(0x3400 + 30 * i + (j * 7 + k) % 30) * 3 for j in range(40)), f"l{i:03d}") for i in range(230) for k in range(6)]
    rows += [(5, "the same text again and again", "l000")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True), sample=1150)
    assert len(model[0]) == 230
    found = language_id.predict(df.where("doc_id % 10 = 5 AND doc_id > 5"), model).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] // 10:03d}" for r in found) >= 0.9 * len(found) == 0.9 * 229
    with pytest.raises(ValueError):
        language_id.train(df, F.lit(True), most_languages=200)


def test_quality_sample_is_bounded(spark):
    """A doc_id that comes often is one row of each sample, on its way to the driver too."""
    docs = spark.createDataFrame([(1, f"a text that comes often {i}") for i in range(400)] + [(i, f"text {i}.") for i in range(2, 52)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 30)], "doc_id long, quality int")
    rows = docs.withColumn("kind", F.lit(0)).union(docs.withColumn("kind", F.lit(1)))
    assert quality_model._featured(rows).count() == 2 * 51
    weights = quality_model.train(docs, labels, F.lit(True))
    assert quality_model.score(docs, weights).count() == 450


def test_errors_in_bits_are_corrected():
    import numpy as np

    code = language_id.codewords(4)
    margins = code * 3.0
    margins[:, 0] *= -1  # one bit wrong in each
    best, score, unsure = language_id.decode(margins, code)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.9).all() and not unsure.any()
    assert language_id.decode(np.zeros((1, code.shape[1])), code)[2][0]


def test_language_held_out(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    out = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_awkward_rows(spark):
    rows = [(1, "the cat and the dog went out", "en"), (2, "le chat et le chien sont partis", "fr"), (3, None, "en"), (4, "123 !?", "fr"), (5, "", None), (None, "the end", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language_id.train(df, F.lit(True))
    out = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert language_id.train(df.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}


def test_nnpu_beats_its_prior():
    import numpy as np

    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (600, 4)), rng.normal(-1.5, 1, (400, 4))
    positive, unlabelled = good[:300], np.vstack([good[300:], bad])
    prior = quality_model.estimate_prior(positive, unlabelled)
    assert abs(prior - 300 / 700) < 0.12
    w = quality_model.fit_nnpu(positive, unlabelled, prior)
    right = ((rng.normal(1.5, 1, (500, 4)) @ w[:-1] + w[-1]) > 0).mean() / 2 + ((rng.normal(-1.5, 1, (500, 4)) @ w[:-1] + w[-1]) <= 0).mean() / 2
    assert right > 0.95


def test_quality_held_out(spark, small):
    sf = small.replace("sf0.001", "sf0.1")
    out = queries.op3_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    low, high = (out.where(F.col("quality") == q).agg(F.avg("score")).first()[0] for q in (0, 1))
    assert low < 0.2 and high > 0.8


def test_quality_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "text", 3), (4, "x" * 100_000, 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, None), (None, 1)], "doc_id long, quality int")
    assert quality_model.train(docs, labels, F.lit(True)) is None
    assert [r["score"] for r in quality_model.score(docs, None).collect()] == [0.5] * 4
    assert quality_model.score(docs.limit(0), None).count() == 0


def merged_one_by_one(own, text, name, dropout, seed):
    """A second way to the ids: of each chunk all pairs of neighbours are looked at anew after each merge. Only the vocabulary is shared."""
    import xxhash

    full = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    known = {own.id_to_piece(i): i for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))}
    letters = set("".join(known))
    document = xxhash.xxh64_intdigest(str(name).encode(), (seed * 1_000_003) & full)
    chunks, at = [], 0
    padded = " " + text
    while at < len(padded):
        end = at
        while end < len(padded) and padded[end] == " ":
            end += 1
        while end < len(padded) and padded[end] != " ":
            end += 1
        chunks.append(padded[at:end])
        at = end
    ids = []
    for number, chunk in enumerate(chunks if text else []):
        key = mix((document + mix(number)) & full)
        parts = [(i, i + 1) for i in range(len(chunk))]
        shown = ["▁" if c == " " else "\0" if c == "▁" else c for c in chunk]
        skipped = set()
        while True:
            best = None
            for (a, b), (_, c) in zip(parts, parts[1:]):
                piece = "".join(shown[a:c])
                if piece in known and (a, b, c) not in skipped and all("".join(shown[x:y]) in known or (y - x == 1 and shown[x] in letters) for x, y in ((a, b), (b, c))):
                    rank = (-own.get_score(known[piece]), a)
                    best = min(best, (rank, a, b, c)) if best else (rank, a, b, c)
            if best is None:
                break
            _, a, b, c = best
            place = ((a << 42 | b << 21 | c) + 0x9E3779B97F4A7C15) & full
            if mix(key ^ mix(place)) < int(dropout * 2**64):
                skipped.add((a, b, c))
                continue
            i = parts.index((a, b))
            parts[i : i + 2] = [(a, c)]
        for a, b in parts:
            piece = "".join(shown[a:b])
            ids += [known[piece]] if piece in known else [own.piece_to_id(f"<0x{x:02X}>") for x in chunk[a:b].encode()]
    return ids


def test_dropout_against_merging_one_by_one(path, spark, small):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = TEXTS + [r[0][:1500] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(25).collect()] + ["the same words over and over " * 40] * 3
    names = [f"doc {i}" for i in range(len(texts))]
    for t, n, blob in zip(texts, names, pieces.Encoder(path, 0.1, 7).encode(texts, names)):
        assert ids_of(blob) == merged_one_by_one(own, t, n, 0.1, 7), t[:60]


def test_models_that_break_the_assumptions_are_refused(monkeypatch):
    """A piece over two words, or more pieces than two bytes tell apart, is an error, not wrong ids."""
    import sentencepiece

    class Fake:
        def __init__(self, pieces, n=None):
            self.all, self.n = pieces, n or len(pieces)

        def __call__(self, model_file):
            return self

        get_piece_size = lambda self: self.n
        id_to_piece = lambda self, i: self.all[i % len(self.all)]
        piece_to_id = lambda self, p: 0
        is_control = is_unknown = is_byte = lambda self, i: False
        get_score = lambda self, i: 0.0

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Fake(["a", "▁a▁b"]))
    with pytest.raises(ValueError, match="two words"):
        pieces.Model("x")
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Fake(["a"], 70_000))
    with pytest.raises(ValueError, match="two bytes"):
        pieces.Model("x")
