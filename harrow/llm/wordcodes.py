"""Words of canonical texts as 64-bit codes, and codes of their runs, for whole batches of texts at once.

A canonical text is free of markup and case-folded; its words are unbroken runs of letters, marks and digits, and every
character of a script without blanks (Han, kana, Thai) is a word.  Texts of a batch are laid end to end as code points;
words are found with a table lookup per code point and hashed by sums of position-weighted codes, so that no word is
ever built as a string.  Texts of any length are read whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from . import markup, plain_text, tokens

BLOCK = 1 << 18  # code points handled at once
BITS = 50  # of the hash of a run; the other bits number the texts of a block
RUN, RUN_UNSPACED = 5, 10
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its kind (0 separates words, 1 is part of one, 2 is one) and a random-looking number."""
    import regex

    whole = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(sys.maxunicode + 1))
    kind = np.zeros(len(whole), np.uint8)
    for k, sign in ((1, r"[\p{L}\p{M}\p{N}]+"), (2, rf"[\p{{Han}}{tokens.KANA_THAI}]+")):
        for m in regex.finditer(sign, whole):
            kind[m.start() : m.end()] = k
    return kind, mix(np.arange(1, len(whole) + 1, dtype=np.uint64) * _ODD)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def canonical(title: str | None, abstract: str | None) -> str:
    """Title and abstract together, without markup, case-folded."""
    parts = [plain_text.clean(t)[0] if markup.SIGNS.search(t) else t for t in (title, abstract) if t]
    return "\n".join(parts).replace("\0", " ").casefold()


def _sums(terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(terms, starts) if starts.size else np.empty(0, np.uint64)


def coded(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, bounds, codes, single) of blocks of canonical texts: text k of a block has the words
    ``codes[bounds[k]:bounds[k + 1]]``; ``single`` marks those of scripts without blanks."""
    kinds, numbers = _tables()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and last - first < 1 << 64 - BITS and (last == first or size + len(texts[last]) < BLOCK):
            size += len(texts[last]) + 1
            last += 1
        points = np.frombuffer("\0".join(texts[first:last]).encode("utf-32-le", "replace"), np.uint32)
        edges = np.flatnonzero(points == 0)
        kind = kinds[points]
        inside = kind > 0
        begins = inside.copy()
        begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.append(starts, len(points)))
        place = np.arange(starts[0] if starts.size else 0, len(points)) - np.repeat(starts, lengths)
        body = slice(starts[0] if starts.size else 0, None)
        terms = np.where(inside[body], numbers[points[body]], np.uint64(0)) * _powers(0x5851F42D4C957F2D, BLOCK + 1)[np.minimum(place, BLOCK)]
        if terms.size and place.max(initial=0) > BLOCK:  # a word longer than a block: its own powers
            terms = np.where(inside[body], numbers[points[body]], np.uint64(0)) * _powers(0x5851F42D4C957F2D, int(place.max()) + 1)[place]
        codes = mix(_sums(terms, starts - body.start)) if starts.size else np.empty(0, np.uint64)
        bounds = np.searchsorted(starts, np.concatenate(([0], edges, [len(points)])))
        yield first, bounds, codes, kind[starts] == 2
        first = last


def wholes(bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of all words of each text, in order; of texts without words 0."""
    sizes = np.diff(bounds)
    filled = np.flatnonzero(sizes)
    starts = bounds[:-1][filled]
    place = np.arange(len(codes)) - np.repeat(starts, sizes[filled])
    out = []
    for base in (0xD1342543DE82EF95, 0xA0761D6478BD642F):
        power = _powers(base, max(BLOCK + 1, int(sizes.max(initial=0))))
        h = np.zeros(len(sizes), np.uint64)
        h[filled] = mix(_sums(mix(codes ^ np.uint64(base)) * power[place], starts) + sizes[filled].astype(np.uint64))
        out.append(h.view(np.int64))
    return out[0], out[1]


def runs(bounds: np.ndarray, codes: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct runs of each text, ascending: five words, ten where they are single characters.

    Hashes have ``BITS`` bits.  A text too short for a run has one for all its words.
    """
    n = len(codes)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    found = []
    have = np.zeros(len(sizes), bool)
    for size, starts in ((RUN, ~single), (RUN_UNSPACED, single)):
        if n < size or not starts.any():
            continue
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h ^= codes[k : n - size + 1 + k]
            h *= _ODD
            h ^= h >> np.uint64(29)
        own = text[: n - size + 1]
        ok = starts[: n - size + 1] & (own == text[size - 1 :])
        own = own[ok]
        have[own] = True
        found.append(own << np.uint64(BITS) | h[ok] >> np.uint64(64 - BITS))
    short = np.flatnonzero(~have & (sizes > 0)).astype(np.uint64)
    if short.size:
        whole = wholes(bounds, codes)[0][short].view(np.uint64)
        found.append(short << np.uint64(BITS) | whole >> np.uint64(64 - BITS))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    both = np.sort(np.concatenate(found))
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    both = both[keep]
    return (both >> np.uint64(BITS)).astype(np.int64), both & np.uint64((1 << BITS) - 1)
