"""Word vectors: skip-grams with negative sampling, trained on counted pairs.

What a round over the texts adds up depends on how often each pair of words stands within the window, not on where. So
the texts are read once, every pair of every text is counted, and each round goes over all counts. A pair ``d`` words
apart counts ``(window + 1 - d) / window``, the share of the rounds in which a window drawn evenly from 1 to ``window``
holds it; the negative samples of a word count by their odds, of all words instead of some drawn ones.

Steps of the rate ``RATE`` for each of ``n`` pairs follow the gradient for the time ``RATE * n``. A round takes that time
in ``HALVES`` implicit steps a side, which hold for any ``n``: the vectors of one side are the least of loss plus
squared way, by the quadratic bound of the logistic loss and ``SOLVE`` conjugate gradients. Rows of one side don't depend
on each other, so a block of rows is a task's work and the result is the same for any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

RATE, DRAWN, POWER = 0.025, 5, 0.75  # learning rate, negative samples a pair, power of the frequencies they are drawn by
HALVES, SOLVE = 2, 4
STRETCH = 1 << 19  # words whose pairs are sorted at once
KEPT = 1 << 22  # pairs a task holds before it gives them on
ROWS, CELLS = 64, 1 << 20  # rows and cells of a block
SHARE = 1 << 24  # cells of a task


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def pair_counts(ids: np.ndarray, texts: np.ndarray, window: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``lesser * v + greater`` of the words of one text at most ``window`` apart, and ``window + 1 - distance`` summed."""
    keys, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(ids), STRETCH):
        for d in range(1, window + 1):
            b, same = ids[at + d : at + d + STRETCH], texts[at + d : at + d + STRETCH]
            a = ids[at : at + len(b)]
            same = same == texts[at : at + len(b)]
            a, b = a[same], b[same]
            found, times = np.unique(np.minimum(a, b) * v + np.maximum(a, b), return_counts=True)
            keys.append(found)
            n.append(times * (window + 1 - d))
    return added(np.concatenate(keys), np.concatenate(n))


def stepped(own: np.ndarray, other: np.ndarray, pos: np.ndarray, neg: np.ndarray, rate: float) -> np.ndarray:
    """``own`` after an implicit step: rows nearer the least of ``pos`` times log-loss of the product with ``other``, plus
    ``neg`` times that of its negative, plus the squared way over twice the rate; never farther from it."""
    z = own @ other.T
    half = np.maximum(np.abs(z) / 2, np.float32(1e-3))
    s = (pos + neg) * np.tanh(half) / (4 * half)
    left = ((pos - neg) / 2 - s * z) @ other
    way, toward, size = np.zeros_like(own), left.copy(), (left * left).sum(1)
    for _ in range(SOLVE):
        bent = ((toward @ other.T) * s) @ other + toward / np.float32(rate)
        by = (size / np.maximum((toward * bent).sum(1), np.float32(1e-30)))[:, None]
        way += by * toward
        left -= by * bent
        now = (left * left).sum(1)
        toward = left + (now / np.maximum(size, np.float32(1e-30)))[:, None] * toward
        size = now
    return own + way


def vocabulary(words: DataFrame, column: str, least: int) -> tuple[list[str], np.ndarray]:
    """Words that occur ``least`` times or more, the most frequent first, and how often."""
    often = words.select(F.explode(column).alias("w")).where("w is not null").groupBy("w").count().where(F.col("count") >= least).collect()
    often.sort(key=lambda r: (-r["count"], r["w"]))
    return [r["w"] for r in often], np.array([r["count"] for r in often], np.float64)


def counted(words: DataFrame, column: str, names: list[str], window: int) -> DataFrame:
    """``a, b, n``: pairs of numbers of words, ``a <= b``, and their weight times ``window``; words not named are passed over."""
    v, known = len(names), words.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = pa.array(known.value, pa.string())
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys // v, keys % v, n)], ["a", "b", "n"])

        for batch in batches:
            lists = batch.column(0)
            ids, texts = pc.index_in(pc.list_flatten(lists), there), pc.list_parent_indices(lists)
            texts = texts.filter(ids.is_valid()).to_numpy(zero_copy_only=False)
            more = pair_counts(ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), texts, window, v)
            keys, n = added(np.concatenate([keys, more[0]]), np.concatenate([n, more[1]]))
            if len(keys) > KEPT:
                yield out()
                keys, n = keys[:0], n[:0]
        yield out()

    pairs = words.select(column).mapInArrow(run, "a bigint, b bigint, n bigint")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def blocks(pairs: DataFrame, v: int, rows: int) -> DataFrame:
    """``g, at, n``: each block of rows of the symmetric table of counts, as one row of cells and their counts; a pair of
    a word with itself counts for both its places."""
    parts = min(max(pairs.sparkSession.sparkContext.defaultParallelism, -(-v * v // SHARE)), -(-v // rows))
    sides = F.explode(F.array(F.struct(F.col("a").alias("r"), F.col("b").alias("c")), F.struct(F.col("b").alias("r"), F.col("a").alias("c"))))
    cells = pairs.select(sides.alias("x"), "n").select(F.floor(F.col("x.r") / rows).cast("int").alias("g"), (F.col("x.r") % rows * v + F.col("x.c")).alias("at"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def out() -> pa.RecordBatch:
            at, n = added(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["g", "at", "n"])

        for batch in batches:
            g, at, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            ends = [*np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)] if len(g) else []
            for lo, hi in zip([0, *ends], ends):
                if g[lo] != last:
                    if held:
                        yield out()
                    held, last = [], int(g[lo])
                held.append((at[lo:hi].copy(), n[lo:hi].copy()))
        if held:
            yield out()

    even = cells.repartitionById(parts, F.col("g") % parts).sortWithinPartitions("g")
    return even.mapInArrow(run, "g int, at binary, n binary")


def trained(words: DataFrame, column: str, dim: int = 300, least: int = 7, window: int = 6, rounds: int = 10, seed: int = 1) -> tuple[list[str], np.ndarray]:
    """The words that occur ``least`` times or more in lists of words, the most frequent first, and their vectors.

    ``words`` is read twice, so it should be a table or a checkpoint. The driver holds the words and two vectors a word.
    """
    sc = words.sparkSession.sparkContext
    names, often = vocabulary(words, column, least)
    v = len(names)
    own = ((np.random.default_rng(seed).random((v, dim)) - 0.5) / dim).astype(np.float32)
    if not v:
        return names, own
    rows = max(16, min(ROWS, CELLS // v))
    table = cut(blocks(counted(words, column, names, window), v, rows))
    odds = often**POWER / (often**POWER).sum()

    def dense(g: int, at: bytes, n: bytes) -> np.ndarray:
        out = np.zeros((min(rows, v - g * rows), v), np.float32)
        out.ravel()[np.frombuffer(at, np.int64)] = np.frombuffer(n, np.int64) / window
        return out

    def each(run) -> Iterator[tuple[slice, np.ndarray]]:
        """Rows of blocks, and what ``run`` makes of their counts."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, at, n in zip(*batch.columns):
                    out = run(slice(g.as_py() * rows, (g.as_py() + 1) * rows), dense(g.as_py(), at.as_buffer(), n.as_buffer()))
                    yield pa.RecordBatch.from_arrays([pa.array([g.as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["g", "v"])

        for r in table.mapInArrow(task, "g int, v binary").collect():
            yield slice(r["g"] * rows, (r["g"] + 1) * rows), r["v"]

    total = np.zeros(v)
    for at, x in each(lambda at, pos: pos.sum(1, dtype=np.float64)):
        total[at] = np.frombuffer(x, np.float64)
    other = np.zeros_like(own)
    for k in range(rounds):
        rate = RATE * (1 - k / rounds) / HALVES
        for side in ("other", "own") * HALVES:
            mine, theirs, here, there = (other, own, odds, total) if side == "other" else (own, other, total, odds)
            sent = sc.broadcast((mine, theirs, here * DRAWN, there))

            def run(at: slice, pos: np.ndarray) -> np.ndarray:
                mine, theirs, here, there = sent.value  # noqa: B023 - the task ends within the loop
                neg = np.outer(here[at], there).astype(np.float32)
                return stepped(mine[at], theirs, pos, neg, rate)  # noqa: B023

            new = mine.copy()
            for at, x in each(run):
                new[at] = np.frombuffer(x, np.float32).reshape(-1, dim)
            own, other = (own, new) if side == "other" else (new, other)
            sent.destroy()
    return names, own


def near(names: list[str], vectors: np.ndarray, word: str, k: int) -> list[tuple[str, float]]:
    """The ``k`` other words of highest cosine with ``word``, the highest first."""
    at = names.index(word)
    unit = vectors.astype(np.float64) / np.maximum(np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True), 1e-12)
    found = sorted((-s, w) for w, s in zip(names, (unit @ unit[at]).tolist()) if w != word)
    return [(w, -s) for s, w in found[:k]]
