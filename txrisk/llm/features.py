"""Hashed features of texts and urls, made in numpy inside tasks."""

from __future__ import annotations

import re

from .common import WORD_BYTES

#: Bytes by class, for the shape of a text: 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 .,;:  6 !?  7 quotes and brackets,
#: 8 #*$%&  9 | and <>  10 other ASCII  11 lead bytes  12 tail bytes of UTF-8.
CLASSES = 13


def _classes():
    import numpy as np

    table = np.full(256, 10, dtype=np.int64)
    for value, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:", "!?", "\"'()[]{}", "#*$%&", "|<>")):
        table[np.frombuffer(chars.encode(), dtype=np.uint8)] = value
    table[128:192], table[192:] = 12, 11
    return table


_table = None
SHAPE = CLASSES * CLASSES + 8


def shape_features(text: str | None):
    """How a text is built, not what it says: shares of pairs of byte classes, and how long, how varied and how repeated its words and
    lines are. The whole text counts; null is empty."""
    import numpy as np

    global _table
    if _table is None:
        _table = _classes()
    data = (text or "").encode()
    out = np.zeros(SHAPE, dtype=np.float32)
    words = re.findall(WORD_BYTES, data)
    if not words:
        return out
    c = _table[np.frombuffer(data, dtype=np.uint8)]
    if len(c) > 1:
        out[: CLASSES * CLASSES] = np.sqrt(np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES) / (len(c) - 1))
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    out[CLASSES * CLASSES :] = (1, np.log1p(n) / 10, len(set(words)) / n, same / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, len(data) / n / 20, (n / len(set(words)) - 1) / 10)
    return out


def gram_features(data: bytes, sizes: tuple[int, ...], width: int):
    """Shares of hashed byte n-grams of these sizes in ``width`` (a power of two) bins; square roots, so common ones don't drown the rest."""
    import numpy as np

    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(width, dtype=np.float32)
    shift = np.uint32(32 - (width.bit_length() - 1))
    for n in sizes:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out += np.bincount((h * np.uint32(0x85EBCA6B)) >> shift, minlength=width)
    total = out.sum()
    return np.sqrt(out / total) if total else out
