"""Mixing sources to target weights by Pareto order sampling.

Each source should give its share of the tokens of the mixture, and no document may be used more often than its
source's cap.  A source whose cap is below its target gives all it may, and the other sources share what is missing by
their weights (water filling), so that the reached shares are the targets as far as the caps allow.

Within a source, a document is expected to be used rate = wanted tokens / tokens of the source times.  floor(rate)
whole copies are certain.  The rest is a sample with inclusion odds by size: p = c * tokens, with documents whose p would
exceed 1 taken for certain.  Pareto order sampling ranks the documents by q = odds(u) / odds(p), u uniform from a hash
of id and seed, and takes the first of them; the sample ends at the document with which the wanted tokens are reached.
That document is found through two histograms of log q, the second inside the edge cell of the first (at most ``CELLS``
numbers a source each); only one cell of the second, a ``CELLS`` squared-th of the range, is sorted.

Defined results: documents whose source is null or not in the targets, and those without tokens, are not used; a target
source without documents gives 0; equal q is ordered by id; an empty table gives a report of zeros.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CELLS = 4096


def allocate(tokens: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens wanted from each source for a mixture of ``total``; sources at their cap pass the rest on by weight."""
    most = {s: float(tokens.get(s, 0)) * max(0, repeats[s] or 0) for s in share}
    out = {s: 0.0 for s in share}
    open_ = {s for s in share if share[s] > 0 and most[s] > 0}
    left = float(total)
    while open_:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / weight >= most[s]}
        if not full:
            for s in open_:
                out[s] = left * share[s] / weight
            break
        for s in full:
            out[s] = most[s]
        left -= sum(most[s] for s in full)
        open_ -= full
    return out


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    total: int | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "n_tokens",
) -> DataFrame:
    """``id_col, source, n_tokens, copies``: how often each used document is in the mixture.

    ``targets``: ``source, target_share, max_repeats``, a row per source (their number bounds what the driver holds).
    ``total``: tokens of the mixture, by default those of all documents of the target sources.
    """
    spark = docs.sparkSession
    want = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r[0] is not None]
    share = {r[0]: r[1] or 0.0 for r in want}
    repeats = {r[0]: r[2] or 0 for r in want}
    names = spark.createDataFrame([(s,) for s in share], "source string")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("bigint").alias("size")
    ).where("size > 0 and id is not null")
    rows = cut(rows.join(F.broadcast(names), "source"))  # a row per source of the targets
    sums = {r[0]: (r[1], r[2]) for r in rows.groupBy("source").agg(F.sum("size"), F.max("size")).collect()}
    tokens = {s: v[0] for s, v in sums.items()}
    wanted = allocate(tokens, share, repeats, sum(tokens.values()) if total is None else total)

    plan = []
    for s in tokens:
        rate = wanted[s] / tokens[s]
        whole = min(int(math.floor(rate + 1e-9)), repeats[s])
        rest = max(0.0, wanted[s] - whole * tokens[s]) if whole < repeats[s] else 0.0
        plan.append((s, whole, rest))
    rests = {s: rest for s, _, rest in plan}
    scale = _scales(rows, rests)
    p = spark.createDataFrame([(s, w, r, scale.get(s, 0.0)) for s, w, r in plan], "source string, whole int, rest double, c double")
    x = rows.join(F.broadcast(p), "source")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    pi = F.least(F.lit(1.0), F.col("c") * F.col("size"))
    log_q = F.log(u / (1 - u)) - F.log(pi / (1 - pi))
    x = x.withColumn("q", F.when(F.col("rest") <= 0, None).when(pi >= 1, F.lit(-1e9)).otherwise(log_q))
    at = (F.col("q") + 40) * (CELLS / 80)
    cell = F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(at))).cast("int")
    fine = F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((at - F.floor(at)) * CELLS))).cast("int")
    x = cut(x.withColumn("cell", F.when(F.col("q").isNotNull(), cell)).withColumn("fine", F.when(F.col("q").isNotNull(), fine)))
    coarse = _border(x.where("q is not null"), "cell", rests)
    inner = x.join(F.broadcast(spark.createDataFrame([(s, k) for s, (k, _) in coarse.items()], "source string, cell int")), ["source", "cell"])
    finest = _border(inner, "fine", {s: missing for s, (_, missing) in coarse.items()})
    borders = [(s, k, *finest.get(s, (CELLS, 0.0))) for s, (k, _) in coarse.items()]
    b = spark.createDataFrame(borders, "source string, border int, edge int, missing double")  # a row per source
    y = x.join(F.broadcast(b), "source", "left")
    inside = (F.col("cell") < F.col("border")) | ((F.col("cell") == F.col("border")) & (F.col("fine") < F.col("edge")))
    on_edge = F.coalesce((F.col("cell") == F.col("border")) & (F.col("fine") == F.col("edge")), F.lit(False))
    sure = y.where(~on_edge)
    sure = sure.select("id", "source", "size", (F.col("whole") + F.when(F.col("q").isNotNull() & inside, 1).otherwise(0)).alias("copies"))
    order = Window.partitionBy("source").orderBy("q", "id").rowsBetween(Window.unboundedPreceding, -1)
    edge = y.where(on_edge).withColumn("sum", F.coalesce(F.sum("size").over(order), F.lit(0)))
    # the document that reaches the target is taken if that misses it by less than leaving it out
    taken = F.col("missing") - F.col("sum") > F.col("size") / 2
    edge = edge.select("id", "source", "size", (F.col("whole") + F.when(taken, 1).otherwise(0)).alias("copies"))
    out = sure.unionAll(edge).where("copies > 0")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("size").alias(size_col), "copies")


def _border(rows: DataFrame, cell: str, wanted: dict[str, float]) -> dict[str, tuple[int, float]]:
    """Of each source, the cell in which its wanted tokens are reached, and how many are missing before it."""
    by_source: dict[str, list[tuple[int, int]]] = {}
    for s, k, t in rows.groupBy("source", cell).agg(F.sum("size").alias("t")).collect():  # at most CELLS rows a source
        by_source.setdefault(s, []).append((k, t))
    out = {}
    for s, cells in by_source.items():
        seen, want = 0, wanted.get(s, 0.0)
        out[s] = (CELLS, 0.0)
        for k, t in sorted(cells):
            if seen + t >= want:
                out[s] = (k, float(want - seen))
                break
            seen += t
    return out


def _scales(rows: DataFrame, rests: dict[str, float]) -> dict[str, float]:
    """c of each source with sum(size * min(1, c * size)) = its rest, by bisection over a histogram of sizes.

    Sizes are grouped to 1 % steps, a few thousand numbers a source at most; the sample's end doesn't depend on it.
    """
    step = F.floor(F.log("size") * 100).cast("int")
    grouped = rows.groupBy("source", step.alias("step")).agg(F.sum("size").alias("t"), F.sum(F.col("size").cast("double") * F.col("size")).alias("t2"))
    hist: dict[str, list[tuple[float, float]]] = {}
    for s, _, t, t2 in grouped.collect():
        hist.setdefault(s, []).append((float(t), t2 / t))  # tokens and their mean size
    out = {}
    for s, cells in hist.items():
        if rests.get(s, 0) <= 0:
            continue
        low, high = 0.0, 1.0
        for _ in range(60):
            c = (low + high) / 2
            low, high = (c, high) if sum(t * min(1.0, c * size) for t, size in cells) < rests[s] else (low, c)
        out[s] = high
    return out


def report(mixed: DataFrame, targets: DataFrame, source_col: str = "source", size_col: str = "n_tokens") -> DataFrame:
    """``source, target_share, max_repeats, n_docs, n_copies, tokens, share``: what each source reached."""
    got = mixed.groupBy(F.col(source_col).alias("source")).agg(
        F.count("*").alias("n_docs"),
        F.sum("copies").cast("bigint").alias("n_copies"),
        F.sum(F.col(size_col) * F.col("copies")).cast("bigint").alias("tokens"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    rows = targets.where("source is not null").join(got, "source", "left")
    rows = rows.select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_copies"), zero("tokens"))
    total = F.sum("tokens").over(Window.partitionBy())  # a row per source
    return rows.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
