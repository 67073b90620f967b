"""Skip-and-fold tables, rolling polynomial hashes over UTF-8 buffers, and a skipping comparison.

One table lookup per code point says whether it is skipped (white space, punctuation, control and format signs) and
what it folds to (full case folding).  Kept code points c_0, c_1, ... of a text give  sum c_i * B**i  mod 2**31-1  for
two bases B; both sums are carried from block to block, so no canonical string is ever built and a text of any length
needs one block of memory.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
BLOCK = 1 << 18  # bytes of text folded at once


@lru_cache(maxsize=1)
def tables() -> tuple:
    """(first, length, (index, rest)): c folds to first[c], or to rest[index[c]] where length[c] > 1; length 0: skip."""
    first = np.zeros(sys.maxunicode + 1, np.uint32)
    length = np.zeros(sys.maxunicode + 1, np.uint8)
    many: dict[int, str] = {}
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.category(ch)[0] in "PZ" or unicodedata.category(ch) in ("Cc", "Cf") or ch.isspace():
            continue
        folded = ch.casefold() or ch
        first[c], length[c] = ord(folded[0]), min(len(folded), 3)
        if len(folded) > 1:
            many[c] = folded
    rest = np.zeros((len(many), 3), np.uint32)
    index = np.zeros(sys.maxunicode + 1, np.uint16)
    for k, (c, folded) in enumerate(many.items()):
        index[c] = k
        rest[k, : len(folded)] = [ord(x) for x in folded[:3]]
    return first, length, (index, rest)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * pow(base, have, PRIME) % PRIME
        have += step
    return out


def fold(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded kept code points of ``codes``; and for each input code point how many it gave."""
    first, length, (index, rest) = tables()
    n = length[codes]
    if n.size and n.max() > 1:
        at = np.repeat(np.arange(codes.size), n)
        nth = np.arange(at.size) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
        source = codes[at]
        return np.where(n[at] > 1, rest[index[source], nth], first[source]), n
    return first[codes[n > 0]], n


def _codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def text_hashes(column: pa.Array) -> np.ndarray:
    """One 62-bit hash per text of an Arrow string column; null counts as empty."""
    n_rows = len(column)
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n_rows + 1]
    else:
        column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n_rows + 1]
    offsets = offsets.astype(np.int64)
    data = memoryview(column.buffers()[2] or b"")
    out = np.zeros((2, n_rows), np.int64)
    row = 0
    while row < n_rows:
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        if last <= row:  # one text longer than a block
            out[:, row] = _long(data, int(offsets[row]), int(offsets[row + 1]))
            row += 1
            continue
        raw = bytes(data[offsets[row] : offsets[last]])
        octets = np.frombuffer(raw, np.uint8)
        ends = np.concatenate(([0], np.cumsum((octets & 0xC0) != 0x80, dtype=np.int64)))[
            offsets[row : last + 1] - offsets[row]
        ]
        kept, n = fold(_codes(raw))
        bounds = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[ends]
        sizes = np.diff(bounds)
        at = np.arange(kept.size) - np.repeat(bounds[:-1], sizes)
        for k, base in enumerate(BASES):
            terms = kept.astype(np.int64) * powers(base, BLOCK)[at] % PRIME
            total = np.concatenate(([0], np.cumsum(terms)))
            out[k, row:last] = (total[bounds[1:]] - total[bounds[:-1]]) % PRIME
        row = last
    return (out[0] << 31) | out[1]


def _long(data: memoryview, start: int, end: int) -> tuple[int, int]:
    h, seen = [0, 0], 0
    while start < end:
        stop = min(start + BLOCK, end)
        while stop < end and data[stop] & 0xC0 == 0x80:
            stop -= 1
        kept, _ = fold(_codes(bytes(data[start:stop])))
        for k, base in enumerate(BASES):
            part = int((kept.astype(np.int64) * powers(base, BLOCK)[: kept.size] % PRIME).sum() % PRIME)
            h[k] = (h[k] + part * pow(base, seen, PRIME)) % PRIME
        seen += kept.size
        start = stop
    return h[0], h[1]


def same(a: str, b: str, block: int = 4096) -> bool:
    """Two pointers walk over both texts, skipping and folding block by block, until they differ or both end."""
    if a == b:
        return True
    i = j = 0
    x = y = np.empty(0, np.uint32)
    while True:
        while x.size == 0 and i < len(a):
            x, i = fold(np.frombuffer(a[i : i + block].encode("utf-32-le", "replace"), np.uint32))[0], i + block
        while y.size == 0 and j < len(b):
            y, j = fold(np.frombuffer(b[j : j + block].encode("utf-32-le", "replace"), np.uint32))[0], j + block
        n = min(x.size, y.size)
        if n == 0:
            return x.size == y.size
        if not np.array_equal(x[:n], y[:n]):
            return False
        x, y = x[n:], y[n:]
