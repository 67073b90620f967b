"""Near-duplicate articles by blocked title and abstract similarity, and merging of what the copies held."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, parallelism, scratch, spread_scan


def _block(words: Column) -> Column:
    key = F.concat_ws("|", F.col("year").cast("string"), F.element_at(words, 1), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))
    return F.when((F.size(words) > 0) & F.col("year").isNotNull(), key)


def block_keys(df: DataFrame) -> DataFrame:
    """``id, block`` of year and the first two normalised title words; titles without words have none."""
    rows = spread_scan(df.select("id", "year", "title")).select("id", "year", T.token_list("title").alias("w"))
    return rows.select("id", _block(F.col("w")).alias("block")).where("block is not null")


def tfidf(df: DataFrame, column: str, used: DataFrame | None = None) -> DataFrame:
    """``id, term, w``: weights of distinct document terms, idf = ln((1+n)/(1+df))+1, rows of unit length.

    Document frequencies are those of all rows; weights are made for the ids of ``used`` only, if it is given.
    """
    rows = df.select("id", column)
    n = df.select("id").count()
    seen = spread_scan(rows).select(F.explode(F.array_distinct(T.token_list(column))).alias("term"))
    idf = seen.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    own = spread_scan(rows) if used is None else rows.join(used, "id", "left_semi")
    tf = own.select("id", F.explode(T.token_list(column)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    raw = cut(tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x")))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("w"))


TILE = 8_192  # rows of a block that a task holds of a side
BUCKET = 20_000  # rows that small blocks are put together to
CELLS = 1 << 19  # pairs that are looked at at once
PRODUCTS = 1 << 22  # products that are summed at once


def duplicates(df: DataFrame) -> DataFrame:
    """``id_a, id_b, title_lev, title_cos, abs_cos`` of the pairs that the rule calls duplicates.

    Pairs are those of one block that aren't the same text; exact copies are joined to their first id only.  Blocks are
    put together to buckets, a task's work; a block of more than ``TILE`` rows is cut into tiles, every two of which
    meet in one bucket.  A task compares all pairs of its tiles but writes only those that the abstracts and an upper
    bound of the titles' likeness let be duplicates: pairs of blocks grow with the square of the table, and none of the
    others is stored or moved.  The idf of its own terms comes with each bucket, so that no vocabulary is broadcast.
    """
    spark = df.sparkSession
    same = F.xxhash64(F.lower("title"), F.lower(F.coalesce("abstract", F.lit(""))))
    none = (F.trim(F.coalesce("abstract", F.lit(""))) == "").alias("none")
    rows = spread_scan(df.select("id", "year", "title", "abstract"))
    rows = rows.select("id", "year", T.token_list("title").alias("w"), T.token_list("abstract").alias("v"), F.lower("title").alias("t"), same.alias("h"), none)
    codes = lambda c, k: F.transform(c, lambda w: F.xxhash64(F.lit(k), w))
    path = scratch(spark, "texts")
    rows.select("id", _block(F.col("w")).alias("block"), "h", "t", "none", codes("w", 0).alias("tt"), codes("v", 1).alias("aa")).write.parquet(path)
    rows = spark.read.parquet(path)
    n = rows.count()
    terms = F.concat("tt", "aa")
    idf = rows.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    buckets = max(parallelism(spark), spark.sparkContext.defaultParallelism, -(-n // BUCKET))
    large = rows.where("block is not null").groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")).where("parts > 1")
    laid = rows.where("block is not null").join(F.broadcast(large), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # large: n / TILE rows at most
    laid = laid.withColumn("p", F.pmod("h", "parts").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    laid = laid.withColumn("i", F.least("p", "q")).withColumn("j", F.greatest("p", "q"))
    laid = laid.withColumn("bucket", F.pmod(F.xxhash64("block", "i", "j"), F.lit(buckets))).drop("parts", "q")
    used = laid.select(F.col("bucket").alias("for"), F.explode(terms).alias("term")).distinct().join(idf, "term")
    found = laid.groupBy("bucket").cogroup(used.groupBy("for")).applyInArrow(_compared, "id_a bigint, id_b bigint, ta string, tb string, none boolean, title_cos double, abs_cos double")
    found = found.withColumn("title_lev", T.similarity("ta", "tb"))
    alike = (F.col("title_lev") >= 0.9) | (F.col("title_cos") >= 0.95)
    rule = (alike & ((F.col("abs_cos") >= 0.85) | F.col("none"))) | ((F.col("title_cos") > 0.8) & (F.col("abs_cos") >= 0.94))
    return found.where(rule).select("id_a", "id_b", "title_lev", "title_cos", "abs_cos")


class _Vectors:
    """Rows of unit length by terms, of a list column of term codes."""

    def __init__(self, column: pa.ChunkedArray, terms: np.ndarray, idf: np.ndarray):
        lists = column.combine_chunks()
        n, size = len(lists), max(len(terms), 1)
        row = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
        key, tf = np.unique(row * size + np.searchsorted(terms, lists.flatten().to_numpy()), return_counts=True)
        row, self.term = key // size, key % size
        x = tf * idf[self.term]
        self.w = x / np.sqrt(np.bincount(row, x * x, minlength=n))[row]
        self.at = np.searchsorted(row, np.arange(n + 1))
        self.dense = np.zeros(size)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``rows``, term and weight of each entry of the rows."""
        n = self.at[rows + 1] - self.at[rows]
        k = np.arange(n.sum()) + np.repeat(self.at[rows] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(rows)), n), self.term[k], self.w[k]

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosines of all of ``a`` with all of ``b``."""
        ra, ta, wa = self.of(a)
        rb, tb, wb = self.of(b)
        order = np.argsort(tb, kind="stable")
        rb, tb, wb = rb[order], tb[order], wb[order]
        lo = np.searchsorted(tb, ta)
        m = np.searchsorted(tb, ta, "right") - lo
        out, ends, s = np.zeros(len(a) * len(b)), np.cumsum(m), 0
        while s < len(m):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PRODUCTS, "right")))
            own = m[s:e]
            k = np.arange(own.sum()) + np.repeat(lo[s:e] - (np.cumsum(own) - own), own)
            cell, first = np.repeat(ra[s:e], own) * len(b) + rb[k], ra[s] * len(b)
            sums = np.bincount(cell - first, np.repeat(wa[s:e], own) * wb[k])
            out[first : first + len(sums)] += sums
            s = e
        return out.reshape(len(a), len(b))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosines of the pairs ``a[k], b[k]``; equal ones of ``a`` stand together."""
        out = np.zeros(len(a))
        edges = [*np.flatnonzero(np.diff(a, prepend=-1)), len(a)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            own = slice(self.at[a[s]], self.at[a[s] + 1])
            self.dense[self.term[own]] = self.w[own]
            row, term, w = self.of(b[s:e])
            out[s:e] = np.bincount(row, self.dense[term] * w, minlength=e - s)
            self.dense[self.term[own]] = 0
        return out


def _signatures(titles: list[str]) -> np.ndarray:
    """Whether the letter pairs of each of 512 kinds are an odd number: an edit changes four of the kinds at most."""
    out = np.zeros((len(titles), 8), np.uint64)
    for s in range(0, len(titles), 4096):
        part = titles[s : s + 4096]
        x = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(part)), [len(t) for t in part])
        kind = ((x[:-1] * np.uint64(0x9E3779B1) + x[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(512)
        within = row[:-1] == row[1:]
        odd = np.bincount(row[:-1][within] * 512 + kind[within].astype(np.int64), minlength=len(part) * 512) & 1
        out[s : s + len(part)] = np.packbits(odd.astype(np.uint8).reshape(-1, 512), axis=1).view(np.uint64)
    return out


def _compared(rows: pa.Table, idf: pa.Table) -> pa.Table:
    """The pairs of a bucket's tiles that may be duplicates, by all of the rule but the edit distance, which has a bound here."""
    out: dict[str, list] = {"a": [], "b": [], "title_cos": [], "abs_cos": []}
    if rows.num_rows:
        order = np.argsort(idf["term"].to_numpy())
        terms, idfs = idf["term"].to_numpy()[order], idf["idf"].to_numpy()[order]
        title, abstract = _Vectors(rows["tt"], terms, idfs), _Vectors(rows["aa"], terms, idfs)
        ids, h, none, part = (rows[c].to_numpy() for c in ("id", "h", "none", "p"))
        texts = rows["t"].to_pylist()
        sign, length = _signatures(texts), np.array([len(t) for t in texts])
        tiles, tile = np.unique(np.stack([rows["block"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["i"].to_numpy(), rows["j"].to_numpy()]), axis=1, return_inverse=True)
        order = np.lexsort((ids, h, tile))
        ends = np.searchsorted(tile[order], np.arange(tiles.shape[1] + 1))

        def first_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The first row of each text, and for each row which of these is its own."""
            new = np.concatenate([[True], h[own][1:] != h[own][:-1]])
            return own[new], np.cumsum(new) - 1

        def keep(a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> None:
            near = abstract.pairs(a, b)
            ok = (near >= 0.85) | none[a] | none[b]
            for name, x in (("a", a), ("b", b), ("title_cos", cos), ("abs_cos", near)):
                out[name].append(x[ok])

        for k, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            own, (_, i, j) = order[s:e], tiles[:, k]
            if len(own) < 2:
                continue
            if i == j:
                left, which = first_of(own)
                right, copies = left, left[which] != own
                if copies.any():
                    a, b = left[which][copies], own[copies]
                    keep(a, b, title.pairs(a, b))
            else:
                left, right = (own[part[own] == x] for x in (i, j))
                left, right = (first_of(x)[0] if len(x) else x for x in (left, right))
            step = max(1, CELLS // max(len(right), 1))
            for s in range(0, len(left), step):
                a, b = left[s : s + step], right[s:] if i == j else right
                cos = title.products(a, b)
                edits = np.floor(0.1 * np.maximum(length[a][:, None], length[b]) + 1e-9)
                odd = np.zeros(cos.shape, np.uint16)
                for c in range(8):
                    odd += np.bitwise_count(sign[a, c][:, None] ^ sign[b, c])
                may = (cos > 0.8) | ((odd <= 4 * edits) & (np.abs(length[a][:, None] - length[b]) <= edits))
                if i == j:
                    may &= np.arange(len(b)) > np.arange(len(a))[:, None]
                x, y = np.nonzero(may)
                keep(a[x], b[y], cos[x, y])
    if not out["a"]:
        return pa.table({"id_a": pa.array([], pa.int64()), "id_b": pa.array([], pa.int64()), "ta": pa.array([], pa.string()), "tb": pa.array([], pa.string()), "none": pa.array([], pa.bool_()), "title_cos": pa.array([], pa.float64()), "abs_cos": pa.array([], pa.float64())})
    a, b, title_cos, abs_cos = (np.concatenate(x) for x in out.values())
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    text = rows["t"].combine_chunks()
    return pa.table({"id_a": ids[a], "id_b": ids[b], "ta": text.take(pa.array(a)), "tb": text.take(pa.array(b)), "none": none[a] | none[b], "title_cos": title_cos, "abs_cos": abs_cos})


def decide(pairs: DataFrame, df: DataFrame, priority: dict[str, int]) -> DataFrame:
    """``kept, deleted``: of each pair the row of the lower priority number stays; of equal ones the earlier."""
    rank = F.lit(max(priority.values(), default=0) + 1)
    for name, value in priority.items():
        rank = F.when(F.col("dataset") == name, value).otherwise(rank)
    r = df.select("id", rank.alias("r"))
    p = pairs.join(r.toDF("id_a", "ra"), "id_a").join(r.toDF("id_b", "rb"), "id_b")
    first = F.col("ra") <= F.col("rb")
    return p.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("kept"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("deleted"))


def report(decided: DataFrame) -> DataFrame:
    """Both rows of each pair with what became of them."""
    left = decided.select(F.col("kept").alias("id"), F.col("kept").alias("group"), F.lit("left").alias("is_deleted"))
    return left.unionAll(decided.select(F.col("deleted").alias("id"), F.col("kept").alias("group"), F.lit("deleted").alias("is_deleted"))).distinct()


def survivors(df: DataFrame, decided: DataFrame) -> DataFrame:
    return df.join(decided.select(F.col("deleted").alias("id")).distinct(), "id", "left_anti")


def merged_lists(df: DataFrame, decided: DataFrame, column: str) -> DataFrame:
    """``id, column``: list of the kept row united with those of the rows deleted for it."""
    own = df.select(F.col("id"), F.explode(column).alias("v"))
    theirs = decided.join(df.select(F.col("id").alias("deleted"), F.explode(column).alias("v")), "deleted").select(F.col("kept").alias("id"), "v")
    kept = own.join(decided.select(F.col("deleted").alias("id")).distinct(), "id", "left_anti").unionAll(theirs)
    return kept.where("v <> ''").distinct().groupBy("id").agg(F.array_sort(F.collect_set("v")).alias(column))
