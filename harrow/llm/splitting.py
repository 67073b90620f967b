"""Splitting oversized texts at natural boundaries, with overlap between consecutive pieces.

The separators form a hierarchy: section, paragraph, sentence, word, character.  A text that is too large is split at
its sections; a section that is still too large at its paragraphs, such a paragraph at its sentences, such a sentence
between words, and a word between characters.  What comes out are the text's parts in order, each small enough to follow
an overlap.  They are packed greedily: a piece takes whole parts while they fit into the limit, and the next piece begins
``overlap`` tokens before its end.

Defined results: null and blank texts give no piece; texts up to the limit give one; every character that is not white
space is in a piece; a last piece may be short, but always holds more than the overlap; the
overlap is exact with the rule's tokens and, with a public tokenizer, the least run of whole words that reaches it; an
overlap of half the limit or more is cut down to less than half.  Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_scan
from . import sentences, tokens

CHARACTER, WORD, SENTENCE, PARAGRAPH, SECTION = range(5)

_heading = re.compile(
    r"^[ \t]{0,3}(?:#{1,6}[ \t]+\S.*|={2,6}[^=\n]+={2,6}|(?:chapter|section|part|annex|appendix)\b.{0,80}|"
    r"\d{1,2}(?:\.\d{1,2})*\.?[ \t]+[^\W\d_][^\n.]{1,78}|[^\Wa-z\d_][^a-z\n]{2,78})[ \t]*$",
    re.M,
)
_paragraph = re.compile(r"\n[ \t\r]*\n\s*|\n(?=[ \t]*(?:[-*+•]|\d{1,3}[.)])\s)")

Units = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, token counts


def rule_units(text: str) -> Units:
    """The tokens of the rule."""
    starts, ends = tokens.rule_spans(text)
    return starts, ends, np.ones(len(starts), np.int64)


def vocabulary_units(path: str, limit: int) -> Callable[[str], Units]:
    """Pre-tokens with their token counts; longer ones than an eighth of the limit in parts between characters."""
    import regex

    encoder, pattern = tokens.vocabulary(path), regex.compile(tokens.PRETOKEN)
    memo: dict[str, int] = {}
    most = max(1, limit // 8)

    def count(word: str) -> int:
        if len(word) > 32:
            return len(encoder.encode_ordinary(word))
        n = memo.get(word)
        if n is None:
            if len(memo) > 1_000_000:
                memo.clear()
            n = memo[word] = len(encoder.encode_ordinary(word))
        return n

    def units(text: str) -> Units:
        out = []
        for m in pattern.finditer(text):
            todo = [m.span()]
            while todo:
                a, b = todo.pop()
                n = count(text[a:b])
                if n <= most or b - a == 1:
                    out.append((a, b, n))
                else:
                    todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        x = np.array(out, np.int64).reshape(-1, 3)
        return x[:, 0], x[:, 1], x[:, 2]

    return units


class Separators:
    """Where each kind of separator stands before a unit of a text; sentences are sought only where they are wanted."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends
        self.blank = np.append(tokens.kind_of(text) == 0, True)
        self._whole: dict[int, np.ndarray] = {}

    def units(self, positions: list[int]) -> np.ndarray:
        """Numbers of the units that begin at character positions, or hold the blank before them."""
        p = np.asarray(positions, np.int64)
        at = np.searchsorted(self.starts, p)
        back = np.maximum(at - 1, 0)
        held = (at > 0) & (self.starts[back] < p) & self.blank[self.starts[back]] & (self.starts[back] >= p - 2)
        return np.unique(np.where(held, back, at))

    def inside(self, kind: int, lo: int, hi: int) -> np.ndarray:
        """Units after ``lo`` and before ``hi`` that stand behind a separator of this kind."""
        if kind == SENTENCE:
            first = int(self.starts[lo])
            found = self.units([first + x for x in sentences.starts(self.text[first : int(self.ends[hi - 1])])])
        else:
            if kind not in self._whole:
                if kind == SECTION:
                    whole = self.units([m.start() for m in _heading.finditer(self.text)])
                elif kind == PARAGRAPH:
                    whole = self.units([m.end() for m in _paragraph.finditer(self.text)])
                else:
                    whole = np.flatnonzero(self.blank[self.starts] | self.blank[np.maximum(self.starts - 1, 0)])
                self._whole[kind] = whole
            found = self._whole[kind]
        return found[np.searchsorted(found, lo, "right") : np.searchsorted(found, hi)]


def parts(before: np.ndarray, separators: Separators, first: int, later: int) -> list[int]:
    """Ends of the parts of a text, in order: at most ``first`` tokens for a part at its start, ``later`` for others.

    ``before``: tokens before each unit, and of all.
    """
    out: list[int] = []
    todo = [(0, len(before) - 1, SECTION)]
    while todo:
        lo, hi, kind = todo.pop()
        most = first if lo == 0 else later
        if before[hi] - before[lo] <= most:
            out.append(hi)
        elif kind == CHARACTER:
            at = max(lo + 1, int(np.searchsorted(before, before[lo] + most, "right")) - 1)
            out.append(at)
            if at < hi:
                todo.append((at, hi, CHARACTER))
        else:
            bounds = [lo, *separators.inside(kind, lo, hi).tolist(), hi]
            todo += [(a, b, kind - 1) for a, b in zip(bounds[-2::-1], bounds[:0:-1])]
    return out


def pack(before: np.ndarray, ends: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Unit ranges [a, b) of the pieces: as many parts as fit, each piece from ``overlap`` tokens before the last one's end."""
    out, a, b, k = [], 0, 0, 0
    bounds = np.asarray(ends)
    while k < len(ends):
        if out:
            a = max(int(np.searchsorted(before, before[b] - overlap, "right")) - 1, a + 1) if overlap else b
        last = int(np.searchsorted(before[bounds], before[a] + limit, "right"))
        k = max(last, k + 1)
        b = ends[k - 1]
        out.append((a, b))
    return out


def split_text(text: str, limit: int, overlap: int, units: Callable[[str], Units] = rule_units) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of ``text``, positions 0-based in characters."""
    starts, ends, n = units(text)
    if not len(starts):
        return []
    before = np.concatenate(([0], np.cumsum(n)))
    if before[-1] <= limit:
        return [(int(starts[0]), int(ends[-1]), int(before[-1]))]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    # whole units may reach further back than the overlap
    later = max(1, limit - overlap - (int(n.max()) - 1 if overlap else 0))
    found = pack(before, parts(before, Separators(text, starts, ends), limit, later), limit, overlap)
    return [(int(starts[a]), int(ends[b - 1]), int(before[b] - before[a])) for a, b in found]


def split(
    df: DataFrame,
    limit: int,
    overlap: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    with_text: bool = True,
) -> DataFrame:
    """``id_col, piece, pieces, start_pos, n_tokens`` and, if wanted, ``piece_text``; positions and numbers from 1.

    ``path``: vocabulary of a public tokenizer, None for the rule.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("text")).where(F.col("text").rlike(r"(?U)\S"))

    name = None if path is None else tokens.shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = rule_units if name is None else vocabulary_units(name, limit)
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = split_text(text, limit, overlap, units)
                for k, (x, y, n) in enumerate(found, 1):
                    out.append((key, k, len(found), x + 1, n, text[x:y] if with_text else None))
            kinds = [b.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = [id_col, "piece", "pieces", "start_pos", "n_tokens", "piece_text"]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            keep = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays(columns[:keep], names=names[:keep])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, pieces int, start_pos int, n_tokens int" + ", piece_text string" * with_text
    return spread_scan(rows).mapInArrow(run, schema)
