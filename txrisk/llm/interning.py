"""An open-addressed hash table in numpy that gives each distinct n-gram of a piece of text a slot."""

from __future__ import annotations

import zlib

BUCKETS = 10_000
# The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def word_table():
    """For each byte its lower-case form, or 0 where it is no part of a word: digits, letters and bytes beyond ASCII are."""
    import numpy as np

    table = np.zeros(256, dtype=np.uint8)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[low:high] = np.arange(low, high)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def _lanes(data, starts, width: int):
    """The ``width`` bytes from each start as one little-endian number; ``data`` is padded at its end."""
    import numpy as np

    return np.lib.stride_tricks.sliding_window_view(data, width)[starts].view(f"<u{width}").ravel()


def xxh64(data, starts, lengths):
    """XXH64 with seed 0 of each slice of ``data`` (uint8, 32 bytes of padding at its end), as numbers of 64 bits."""
    import numpy as np
    import xxhash

    u = np.uint64
    turn = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    h = lengths.astype(np.uint64) + u(P5)
    at = starts.copy()
    for _ in range(3):  # lanes of eight bytes; a slice of 32 bytes or more is done below
        i = np.flatnonzero(lengths - (at - starts) >= 8)
        if not len(i):
            break
        x = h[i] ^ (turn(_lanes(data, at[i], 8) * u(P2), 31) * u(P1))
        h[i] = turn(x, 27) * u(P1) + u(P4)
        at[i] += 8
    i = np.flatnonzero(lengths - (at - starts) >= 4)
    h[i] = turn(h[i] ^ (_lanes(data, at[i], 4).astype(np.uint64) * u(P1)), 23) * u(P2) + u(P3)
    at[i] += 4
    for _ in range(3):
        i = np.flatnonzero((lengths > at - starts) & (lengths < 32))
        if not len(i):
            break
        h[i] = turn(h[i] ^ (data[at[i]].astype(np.uint64) * u(P5)), 11) * u(P1)
        at[i] += 1
    h ^= h >> u(33)
    h *= u(P2)
    h ^= h >> u(29)
    h *= u(P3)
    h ^= h >> u(32)
    for i in np.flatnonzero(lengths >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return h


def _equal(data, starts, lengths, a, b):
    """Whether slices a and b, of one length each, have the same bytes."""
    import numpy as np

    out = np.ones(len(a), dtype=bool)
    at, live = 0, np.arange(len(a))
    while len(live):
        x, y = starts[a[live]] + at, starts[b[live]] + at
        left = lengths[a[live]] - at
        mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        same = ((_lanes(data, x, 8) ^ _lanes(data, y, 8)) & mask) == 0
        out[live[~same]] = False
        at += 8
        live = live[same & (left > 8)]
    return out


def intern(data, starts, lengths, hashes=None):
    """(slot of each slice, owner of each slot): equal slices have one slot, others have other slots; a free slot's owner is -1, else a slice.

    The table is at most half full. In each round every slice that has no slot yet looks at its next place: free places take one of those that ask, whoever finds its own
    bytes there has its slot, and the others go on to the next place. Slices are compared by hash, then by all their bytes, so equal hashes of
    different bytes do no harm."""
    import numpy as np

    n = len(starts)
    hashes = xxh64(data, starts, lengths) if hashes is None else hashes
    size = 1 << max(4, int(2 * n - 1).bit_length() if n else 4)
    owner, slots = np.full(size, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    place = (hashes & np.uint64(size - 1)).astype(np.int64)
    left = np.arange(n)
    while len(left):
        at = place[left]
        free = owner[at] < 0
        owner[at[free]] = left[free]
        held = owner[at]
        same = (hashes[held] == hashes[left]) & (lengths[held] == lengths[left])
        maybe = np.flatnonzero(same & (held != left))
        same[maybe] = _equal(data, starts, lengths, held[maybe], left[maybe])
        slots[left[same]] = at[same]
        left = left[~same]
        place[left] = (place[left] + 1) & (size - 1)
    return slots, owner


class Counter:
    """Sums over pieces: n-grams by bucket, or by text what they gain."""

    def __init__(self, buckets: int, gains=None, texts: int = 0):
        import numpy as np

        self.gains, self.total = gains, np.zeros(buckets, dtype=np.int64)
        self.words, self.features, self.gained = (np.zeros(texts, dtype=np.int64) for _ in range(3))

    def add(self, slots, owner, bucket, texts) -> None:
        """``texts``: the text of each occurrence; ``bucket``: of each taken slot."""
        import numpy as np

        taken = np.flatnonzero(owner >= 0)
        if self.gains is None:
            count = np.bincount(slots, minlength=len(owner))[taken]
            self.total += np.bincount(bucket[taken], weights=count, minlength=len(self.total)).astype(np.int64)
            return
        gain = np.zeros(len(owner), dtype=np.int64)
        gain[taken] = self.gains[bucket[taken]]
        np.add.at(self.gained, texts, gain[slots])
        self.features += np.bincount(texts, minlength=len(self.features))


def _pieces(data, offsets, size: int, kept: int):
    """(bytes, first byte of each text, number of the first text, bytes of words seen before) of pieces of about ``size`` bytes: whole texts, or parts of a longer one that end
    between two words and begin with the last ``kept`` words of the part before."""
    import numpy as np

    table, first, n = word_table(), 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= size or last > first + 1:
            yield data[begin:end], offsets[first:last] - begin, first, 0
        else:
            seen, at = b"", begin
            while at < end:
                to = min(at + size, end)
                while to < end and table[data[to]] and table[data[to - 1]]:  # to the end of the word
                    to += 1
                part = np.concatenate([np.frombuffer(seen, dtype=np.uint8), data[at:to]])
                yield part, np.zeros(1, dtype=np.int64), first, len(seen)
                if kept:
                    seen = b"".join(w + b" " for w in [w for w in table[part].tobytes().split(b"\0") if w][-kept:])
                at = to
        first = last


def intern_batches(texts, ngrams: tuple[int, int], buckets: int, size: int, counter: Counter) -> None:
    """Intern the n-grams of an Arrow column of texts piece by piece, and give them to ``counter``."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    table = word_table()
    for part, begins, first, seen in _pieces(raw, offsets, size, ngrams[1] - 1):
        low = table[part]
        is_word = low > 0
        head, tail = is_word.copy(), is_word.copy()
        head[1:] &= ~is_word[:-1]
        tail[:-1] &= ~is_word[1:]
        inner = begins[(begins > 0) & (begins < len(part))]  # a word ends where its text does
        head[inner] = is_word[inner]
        tail[inner - 1] = is_word[inner - 1]
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        if not len(starts):
            continue
        text = first + np.searchsorted(begins, starts, "right") - 1
        fresh = starts >= seen
        if counter.gains is not None:
            counter.words += np.bincount(text[fresh], minlength=len(counter.words))
        # the words again, each with one space after it
        lengths = ends - starts
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        joined = low[np.minimum(np.arange(at[-1]) - np.repeat(at[:-1] - starts, lengths + 1), len(low) - 1)]
        joined[at[1:] - 1] = 32
        joined = np.concatenate([joined, np.zeros(32, dtype=np.uint8)])
        for n in range(ngrams[0], ngrams[1] + 1):
            k = len(starts) - n + 1
            if k <= 0:
                break
            whole = np.flatnonzero((text[:k] == text[n - 1 :]) & fresh[n - 1 :])
            if not len(whole):
                continue
            a, b = at[whole], at[whole + n] - 1
            slots, owner = intern(joined, a, b - a)
            bucket = np.zeros(len(owner), dtype=np.int64)
            for s in np.flatnonzero(owner >= 0).tolist():
                o = owner[s]
                bucket[s] = zlib.crc32(joined[a[o] : b[o]].tobytes()) % buckets
            counter.add(slots, owner, bucket, text[whole])
