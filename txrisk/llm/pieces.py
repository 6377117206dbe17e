"""SentencePiece BPE with seeded merge-dropout: varied segmentations that decode to the text they came from."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = "▁"
#: A chunk is a run of spaces and what follows up to the next space. No piece of a model may span two chunks.
CHUNK = re.compile(" *[^ ]+| +")
#: Chunks of up to so many symbols are merged in step with others; longer ones by an agenda of their own.
IN_STEP = 48
#: Forms of chunks that a task remembers: beyond it the memory is emptied. It bounds a worker's memory and changes no result.
MEMORY = 1_000_000
#: How many dropped merges of an occurrence are followed from form to form.
DEPTH = 4
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)


class Model:
    """The vocabulary of a SentencePiece BPE model with byte fallback: pieces, scores, and for each pair of symbols its merge."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if n > 1 << 16:
            raise ValueError(f"{path} has {n} pieces; ids of two bytes tell {1 << 16} apart")
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if wide := next((p for p in self.ids if SPACE in p.lstrip(SPACE)), None):
            raise ValueError(f"piece {wide!r} of {path} spans two words; chunks between spaces can't be merged by themselves")
        # Characters inside pieces that are no pieces by themselves take part in merges under ids past the vocabulary.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, len(self.pieces) + len(self.symbols) - len(self.ids))
        self.n = n
        self.stranger = n + len(self.symbols) - len(self.ids)  # any character that no piece has
        # rank: best score first; equal scores are one rank, among which the leftmost place wins
        scores = np.array([m.get_score(i) for i in range(n)])
        rank = {s: k for k, s in enumerate(sorted(set(scores.tolist()), reverse=True))}
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank[float(scores[i])], i)
        self.pairs = pairs
        self.span = self.stranger + 1
        keys = np.array([a * self.span + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        # an open table: a multiplied key names a slot, and few keys share one
        self.bits = 19
        slots = self._slot(keys)
        taken: dict[int, int] = {}
        self.probes = 1
        for k in order.tolist():
            at, step = int(slots[k]), 1
            while at in taken:
                at, step = (at + 1) & ((1 << self.bits) - 1), step + 1
            taken[at] = k
            self.probes = max(self.probes, step)
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.bits, 1 << 30, dtype=np.int64)
        self.slot_id = np.zeros(1 << self.bits, dtype=np.int64)
        ranks = np.array([v[0] for v in pairs.values()], dtype=np.int64)
        ids = np.array([v[1] for v in pairs.values()], dtype=np.int64)
        at = np.fromiter(taken.keys(), dtype=np.int64)
        k = np.fromiter(taken.values(), dtype=np.int64)
        self.slot_key[at], self.slot_rank[at], self.slot_id[at] = keys[k], ranks[k], ids[k]
        # a code point's symbol; a SPACE of the text itself is a stranger, so that decoding gives it back
        self.symbol_of_point = np.full(0x110000, self.stranger, dtype=np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.symbol_of_point[ord(c)] = i
        self.symbol_of_point[ord(" ")], self.symbol_of_point[ord(SPACE)] = self.symbols.get(SPACE, self.stranger), self.stranger
        # decoding: a piece's bytes, spaces restored
        self.bytes = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])

    def _slot(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left, right):
        """Rank and id of the merge of each pair; rank 2^30 where there is none."""
        import numpy as np

        keys = left * self.span + right
        at = self._slot(keys)
        found = np.full(len(keys), 1 << 30, dtype=np.int64)
        ids = np.zeros(len(keys), dtype=np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            here = self.slot_key[at]
            hit = here == keys
            found[open_[hit]], ids[open_[hit]] = self.slot_rank[at[hit]], self.slot_id[at[hit]]
            more = ~hit & (here >= 0)
            if not more.any():
                break
            open_, keys, at = open_[more], keys[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return found, ids

    def symbols_of(self, chunk: str) -> list[int]:
        """One symbol a character."""
        return [int(self.symbol_of_point[ord(c)]) for c in chunk]

    def finish(self, chunk: str, symbols: list[tuple[int, int]]) -> bytes:
        """The ids, two bytes each, of (symbol, length) in order; what isn't in the vocabulary goes as bytes."""
        import numpy as np

        out, at = [], 0
        for s, n in symbols:
            if s < self.n:
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in chunk[at : at + n].encode()]
            at += n
        return np.array(out, dtype="<u2").tobytes()


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _mix(x):
    """A 64-bit finaliser for numpy arrays of unsigned values."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_key(chunk: str, variant: int, seed: int) -> int:
    """A key of a name, a number and the seed."""
    import xxhash

    return xxhash.xxh64_intdigest(chunk.encode(), (seed * 1_000_003 + variant) & (2**64 - 1))


def dropped(key, start, middle, end, limit):
    """Whether the candidate merge of [start, middle) and [middle, end) of the chunk with this key is skipped: its keyed hash is under
    ``limit``. It depends on nothing else, so every way to work through the candidates skips the same ones."""
    import numpy as np

    return _mix(key ^ hashed_bounds(start, middle, end)) < np.uint64(limit)


def _dropped_one(key: int, start: int, middle: int, end: int, limit: int) -> bool:
    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    return mix(key ^ mix(((start << 42 | middle << 21 | end) + 0x9E3779B97F4A7C15) & mask)) < limit


def by_agenda(m: Model, chunk: str, key: int, limit: int) -> bytes:
    """One chunk by an agenda of candidate merges, best score first, then leftmost. A candidate whose keyed hash is under ``limit`` is
    skipped when its turn comes."""
    sym = m.symbols_of(chunk)
    n = len(sym)
    size, left, right = [1] * n, [*range(-1, n - 1)], [*range(1, n), -1]
    agenda = []

    def offer(i):
        j = right[i] if i >= 0 else -1
        if j >= 0 and (found := m.pairs.get((sym[i], sym[j]))):
            heapq.heappush(agenda, (found[0], i, size[i], size[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, a, b, made = heapq.heappop(agenda)
        if size[i] != a or (j := right[i]) < 0 or size[j] != b:
            continue  # one of the two has been merged meanwhile
        if limit and _dropped_one(key, i, i + a, i + a + b, limit):
            continue
        sym[i], size[i], size[j], right[i] = made, a + b, 0, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return m.finish(chunk, [(sym[i], size[i]) for i in range(n) if size[i]])


def hashed_bounds(start, middle, end):
    """A hash of the bounds of candidate merges."""
    import numpy as np

    place = (start.astype(np.uint64) << np.uint64(42)) | (middle.astype(np.uint64) << np.uint64(21)) | end.astype(np.uint64)
    return _mix(place + np.uint64(0x9E3779B97F4A7C15))


def in_step(m: Model, chunks: list[str], keys, limit: int, made_of: list | None = None, skips=None) -> list[bytes]:
    """Many short chunks at once: of each, the best merge left is made, until none has any. Chunks of one length are the rows of a
    table; its columns are the characters, each naming the next and the one before that still begin a symbol. ``made_of`` collects
    (chunk numbers, bound hashes) of the merges made; candidates whose bound hashes are in a chunk's row of ``skips`` are skipped, too."""
    import numpy as np

    done: list = [None] * len(chunks)
    sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
    key = np.array(keys, dtype=np.uint64)
    for length in np.unique(sizes).tolist():
        who = np.flatnonzero(sizes == length)
        points = np.frombuffer("".join([chunks[i] for i in who]).encode("utf-32-le"), dtype="<u4").reshape(-1, length)
        sym = m.symbol_of_point[points]
        n, none = len(who), np.int32(1 << 30)
        after = np.broadcast_to(np.arange(1, length + 2), (n, length + 1)).copy()  # of the place past the end: itself
        after[:, length - 1 :] = length
        before = np.broadcast_to(np.arange(-1, length), (n, length + 1)).copy()
        rank = np.full((n, length), none, dtype=np.int32)
        made = np.zeros((n, length), dtype=np.int32)

        def offer(rows, at):
            """Rank anew the pairs that begin at these places."""
            second = after[rows, at]  # noqa: B023
            inside = second < length  # noqa: B023
            r, i = m.look_up(sym[rows, at].astype(np.int64), sym[rows, np.minimum(second, length - 1)].astype(np.int64))  # noqa: B023
            r[~inside] = none  # noqa: B023
            if limit and (live := np.flatnonzero(r < none)).size:  # noqa: B023
                end = after[rows[live], second[live]]  # noqa: B023
                r[live[dropped(key[who[rows[live]]], at[live], second[live], end, np.uint64(limit))]] = none  # noqa: B023
            if skips is not None and (live := np.flatnonzero(r < none)).size:  # noqa: B023
                place = hashed_bounds(at[live], second[live], after[rows[live], second[live]])  # noqa: B023
                r[live[(skips[who[rows[live]]] == place[:, None]).any(axis=1)]] = none  # noqa: B023
            rank[rows, at], made[rows, at] = r, i  # noqa: B023

        if length > 1:
            rows, at = np.divmod(np.arange(n * (length - 1)), length - 1)
            offer(rows, at)
        going = np.arange(n)
        while length > 1 and len(going):
            best = rank[going].argmin(axis=1)  # the leftmost of the least
            has = rank[going, best] < none
            going, at = going[has], best[has]
            if not len(going):
                break
            second = after[going, at]
            third = after[going, second]
            if made_of is not None:
                made_of.append((who[going], hashed_bounds(at, second, third)))
            sym[going, at] = made[going, at]
            after[going, at], before[going, third] = third, at
            sym[going, second], rank[going, second] = -1, none
            first = before[going, at]
            back = first >= 0
            offer(np.concatenate((going, going[back])), np.concatenate((at, first[back])))
        alive = sym >= 0
        strange = (sym >= m.n).any(axis=1)
        ends = (np.cumsum(alive.sum(axis=1)) * 2).tolist()
        flat = sym[alive].astype("<u2").tobytes()
        start = 0
        for i, end, odd in zip(who.tolist(), ends, strange.tolist()):
            done[i] = flat[start:end]
            start = end
            if odd:
                row = int(np.searchsorted(who, i))
                places = np.flatnonzero(alive[row])
                done[i] = m.finish(chunks[i], list(zip(sym[row, places].tolist(), np.diff(np.append(places, length)).tolist())))
    return done


class Encoder:
    """Encodes texts of one task. Of each chunk the form without dropped merges is remembered, with its merges in their order. A chunk's
    occurrence of which none of these is dropped has this form. In any other the first one dropped is known to be skipped, which leads to another
    form, remembered under the first with its own merges; these are looked at in turn. So an occurrence is decided by its own key,
    merge by merge. What comes once among the texts at hand, and what has over DEPTH dropped merges, is merged directly instead."""

    def __init__(self, path: str, dropout: float, seed: int, variants: int | None = None):
        self.m, self.seed, self.variants = model(path), seed, variants
        self.limit = min(2**64 - 1, int(dropout * 2**64))
        self.forget()

    def forget(self):
        import numpy as np

        self.known: dict[str, int] = {}
        #: Of each form its chunk, ids, and the merges skipped on the way to it; ``after`` leads from a form and the place of its first dropped merge to the next.
        self.chunk: list[str] = []
        self.plain: list[bytes] = []
        self.skipped: list[tuple] = []
        self.after: dict[int, int] = {}
        self.start, self.merges = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def key(self, name) -> int:
        """A document's key; with ``variants``, one of so many."""
        import xxhash

        if self.variants:
            return chunk_key("", xxhash.xxh64_intdigest(str(name), self.seed & (2**64 - 1)) % self.variants, self.seed)
        return chunk_key(str(name), 0, self.seed)

    def learn(self, chunks: list[str], skipped: list[tuple]):
        """Remember the forms of short chunks when these merges are skipped, and the merges that make them."""
        import numpy as np

        starts, merges = [self.start], [self.merges]
        for at in range(0, len(chunks), 1 << 15):
            part, skips, made_of = chunks[at : at + (1 << 15)], skipped[at : at + (1 << 15)], []
            deep = max(map(len, skips))
            table = np.array([[*x, *[0] * (deep - len(x))] for x in skips], dtype=np.uint64) if deep else None
            self.plain += in_step(self.m, part, [0] * len(part), 0, made_of, table)
            self.chunk += part
            self.skipped += skips
            who = np.concatenate([np.zeros(0, dtype=np.int64), *[w for w, _ in made_of]])
            what = np.concatenate([np.zeros(0, dtype=np.uint64), *[x for _, x in made_of]])
            merges.append(what[np.argsort(who, kind="stable")])
            starts.append(starts[-1][-1] + np.cumsum(np.bincount(who, minlength=len(part))))
        self.start, self.merges = np.concatenate(starts), np.concatenate(merges)

    def first_dropped(self, forms, keys):
        """The place of the first merge of each form that is dropped in this occurrence of it; -1 for none."""
        import numpy as np

        first, n = self.start[forms], self.start[forms + 1] - self.start[forms]
        ends = np.cumsum(n)
        who = np.repeat(np.arange(len(forms)), n)
        at = np.arange(len(who)) + np.repeat(first - (ends - n), n)
        hit = np.flatnonzero(_mix(keys[who] ^ self.merges[at]) < np.uint64(self.limit))
        out = np.full(len(forms), -1, dtype=np.int64)
        dropped_in, where = np.unique(who[hit], return_index=True)
        out[dropped_in] = hit[where] - (ends - n)[dropped_in]
        return out

    def encode(self, texts: list[str], names: list) -> list[bytes]:
        """The ids of each text, two bytes each. A merge is dropped by the document's name, the number of the chunk in its text, and the bounds."""
        import numpy as np

        if len(self.plain) > MEMORY:
            self.forget()
        cut = [CHUNK.findall(" " + t) if t else [] for t in texts]
        flat = [c for chunks in cut for c in chunks]
        short = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) <= IN_STEP
        found = [self.known.get(c, -1) for c in flat]
        often = Counter(flat[i] for i, k in enumerate(found) if k < 0)
        if new := [c for c, n in often.items() if n > 1 and len(c) <= IN_STEP]:
            self.known.update(zip(new, range(len(self.plain), len(self.plain) + len(new))))
            self.learn(new, [()] * len(new))
            found = [self.known.get(c, -1) if k < 0 else k for c, k in zip(flat, found)]
        forms = np.array(found, dtype=np.int64)
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        ends = np.cumsum(sizes)
        place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        keys = _mix(np.repeat(np.array([self.key(x) for x in names], dtype=np.uint64), sizes) + _mix(place.astype(np.uint64)))
        direct = [np.flatnonzero(short & (forms < 0))]
        left = np.flatnonzero(forms >= 0) if self.limit else np.zeros(0, dtype=np.int64)
        for depth in range(DEPTH + 1):
            first = self.first_dropped(forms[left], keys[left])
            left, first = left[first >= 0], first[first >= 0]
            if depth == DEPTH or not len(left):
                break
            steps, which, often = np.unique(forms[left] * (IN_STEP + 1) + first, return_inverse=True, return_counts=True)
            to = np.array([self.after.get(x, -1) for x in steps.tolist()], dtype=np.int64)
            new = np.flatnonzero((to < 0) & (often > 1))
            if len(new):
                to[new] = np.arange(len(self.plain), len(self.plain) + len(new))
                self.after.update(zip(steps[new].tolist(), to[new].tolist()))
                above = [divmod(x, IN_STEP + 1) for x in steps[new].tolist()]
                self.learn([self.chunk[f] for f, _ in above], [(*self.skipped[f], int(self.merges[self.start[f] + j])) for f, j in above])
            forms[left] = to[which]
            direct.append(left[forms[left] < 0])
            left = left[forms[left] >= 0]
        direct = np.concatenate([*direct, left])
        plain = self.plain
        out = [plain[k] if k >= 0 else b"" for k in forms.tolist()]
        for i in np.flatnonzero(~short).tolist():
            out[i] = by_agenda(self.m, flat[i], int(keys[i]), self.limit)
        for at in range(0, len(direct), 1 << 15):
            part = direct[at : at + (1 << 15)]
            for i, ids in zip(part.tolist(), in_step(self.m, [flat[i] for i in part.tolist()], keys[part], self.limit)):
                out[i] = ids
        return [b"".join(out[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]


_encoders: dict[tuple, Encoder] = {}


def decode_ids(m: Model, ids) -> str:
    """The text of a sequence of ids: their bytes in order without the space that encoding put in front."""
    return b"".join(map(m.bytes.__getitem__, ids)).decode()[1:]


def _encode_batches(path: str, dropout: float, seed: int, variants: int | None, what: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = _encoders.setdefault((path, dropout, seed, variants), Encoder(path, dropout, seed, variants))  # a worker's tasks share it
        for batch in batches:
            given = batch.column("text").to_pylist()
            lists, step, size, names = [], [], 0, batch.column("name").to_pylist()
            for i, t in enumerate(given):  # so many characters at a time that new chunks are many, and memory is bounded
                step.append(i)
                size += len(t or "")
                if size > 4_000_000 or i == len(given) - 1:
                    lists += encoder.encode([given[k] or "" for k in step], [names[k] for k in step])
                    step, size = [], 0
            ids = [np.frombuffer(x, dtype="<u2") for x in lists]
            if what == "ids":
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, "<u2")]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([t is None for t in given]))
                yield pa.RecordBatch.from_arrays([batch.column("row"), column], ["row", "ids"])
            else:
                m = encoder.m
                same = [t is not None and decode_ids(m, x.tolist()) == t if t else t == "" for t, x in zip(given, ids)]
                counts = pa.array([None if t is None else len(x) for t, x in zip(given, ids)], pa.int64())
                digest = pa.array([None if t is None else hashlib.sha256(x).hexdigest() for t, x in zip(given, lists)])
                yield pa.RecordBatch.from_arrays([batch.column("row"), counts, digest, pa.array([None if t is None else s for t, s in zip(given, same)], pa.bool_())], ["row", "n_pieces", "ids_sha256", "lossless"])

    return run


def _prepared(docs: DataFrame, name: Column) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text", name.cast("string").alias("name"))


def encode(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, variants: int | None = None, name: Column | None = None) -> DataFrame:
    """``docs`` without its text and with ``ids`` (array<int>) in its place.

    A text is cut before each run of spaces; characters of a chunk are merged best piece first, leftmost first among equals, as the
    model's own encoder does, except that a candidate merge is skipped for good if its hash, keyed by the seed, the document's ``name`` (its doc_id), the
    chunk's number in the text and the candidate's bounds, is under ``dropout``. What is left over goes as pieces or as bytes, so any text decodes
    to itself. With ``variants``, names count only as one of so many; dropout 0 gives the model's own. A null
    text has null ids, an empty one none. A column called ids is replaced. The result depends on no other row, batch or task."""
    docs = docs.drop("ids")
    kind = docs.drop("text").schema
    out = _prepared(docs, F.col("doc_id") if name is None else name).mapInArrow(_encode_batches(path, dropout, seed, variants, "ids"), f"row {kind.simpleString()}, ids array<int>")
    return out.select("row.*", "ids")


def encode_copies(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """``encode`` of a table in which a document may come several times, once for each epoch it is drawn in: its copies are numbered, and each
    has a segmentation of its own. Which of equal rows has which number is open and changes no result."""
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[c for c in docs.columns if c != "text"])))
    numbered = docs.withColumn("__copy", copy)
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.when(F.col("__copy") > 1, F.col("__copy")).cast("string"))
    return encode(numbered, path, dropout, seed, name=name).drop("__copy")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``text`` in place of ``ids``; null ids give a null text."""
    encoded = encoded.drop("text")
    kind = encoded.drop("ids").schema

    def run(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            texts = [None if x is None else decode_ids(m, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    row = F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c != "ids"]).alias("row")
    return encoded.select(row, "ids").mapInArrow(run, f"row {kind.simpleString()}, text string").select("row.*", "text")


def digest(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, variants: int | None = None) -> DataFrame:
    """For each document: doc_id, n_pieces, ids_sha256 (of its ids as two-byte little-endian values) and lossless (they decode to its
    text); nulls for a null text. The ids are those of ``encode``; they are decoded and compared where they are made."""
    only = docs.select("doc_id", "text")
    out = _prepared(only, F.col("doc_id")).mapInArrow(_encode_batches(path, dropout, seed, variants, "digest"), f"row {only.drop('text').schema.simpleString()}, n_pieces long, ids_sha256 string, lossless boolean")
    return out.select("row.*", "n_pieces", "ids_sha256", "lossless")
