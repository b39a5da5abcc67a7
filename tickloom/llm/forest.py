"""Approximate nearest neighbours with a hash-prefix forest.

Every tree is a sorted array of 64-bit hash strings, one sign of a random projection per bit. A query descends
each tree to its longest matching prefix and all trees ascend together, one bit at a time, until the ranges that
share the prefix hold ``candidates`` entries in all; whole ranges are taken, never parts of one. Candidates are
ranked by Euclidean distance in double precision.

Rows are dealt by hash into blocks of about ``BLOCK`` rows with a forest each; every block of queries visits
every block of rows. Blocks lie in the checkpoint folder and are read where they meet: none is shuffled or broadcast,
and a task merges the nearest of its visits before they leave it. A block's work and memory are bounded however
common a vector is.

Projections are drawn from a fixed seed; their centre is the mean of the block's own rows, so nothing is fitted
on a sample. Recall against brute force is measured in the tests.

Null, zero and non-finite vectors and rows with a null vec_id take no part. A query never meets rows of its own
vec_id. Query rows that repeat in full are one query; rows that share a vec_id with other vectors are queries of their own, each with
its ranks from 1. Vectors of different lengths do not meet. With fewer candidates than ``k``, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.vectors import packed_blocks, unpack, usable

TREES, CANDIDATES, BLOCK, QUERY_BLOCK = 32, 2600, 4096, 1024
BITS = 64
#: Partitions of the blocks of rows at most; each gives the ``k`` nearest of every query.
PARTS = 64


class Forest:
    """Sorted hash strings of one block of vectors."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centre = x.mean(axis=0)
        self.planes = rng.standard_normal((x.shape[1], trees * BITS)).astype(np.float32)
        labels = self.labels(x)
        self.order = np.argsort(labels, axis=1, kind="stable")
        self.sorted = np.take_along_axis(labels, self.order, axis=1)

    def labels(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings, the first bit highest."""
        signs = (x - self.centre).astype(np.float32) @ self.planes > 0
        packed = np.packbits(signs.reshape(len(x), -1, BITS), axis=2, bitorder="big")
        return np.ascontiguousarray(packed.view(">u8")[:, :, 0].T.astype(np.uint64))

    def candidates(self, q: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows in the ranges at the greatest depth that hold ``least`` entries in all trees."""
        own = self.labels(q)
        n = self.sorted.shape[1]
        lows, highs = np.zeros(own.shape, np.intp), np.full(own.shape, n, np.intp)
        open_ = np.ones(len(q), bool)
        for depth in range(BITS, 0, -1):
            rest = np.uint64((1 << (BITS - depth)) - 1)
            at = np.flatnonzero(open_)
            if not len(at):
                break
            low, high = np.empty((len(own), len(at)), np.intp), np.empty((len(own), len(at)), np.intp)
            for t, row in enumerate(self.sorted):
                low[t] = np.searchsorted(row, own[t, at] & ~rest, side="left")
                high[t] = np.searchsorted(row, own[t, at] | rest, side="right")
            done = (high - low).sum(axis=0) >= least
            lows[:, at[done]], highs[:, at[done]] = low[:, done], high[:, done]
            open_[at[done]] = False
        for i in range(len(q)):
            hit = np.zeros(n, bool)
            for t, (a, b) in enumerate(zip(lows[:, i], highs[:, i])):
                hit[self.order[t, a:b]] = True
            yield np.flatnonzero(hit)


def search(forest: Forest, x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int, least: int):
    """(query number, row id, distance) of the k nearest candidates of each query."""
    of, found, score = [], [], []
    # squared distances by a product, and twice what they can be off; exact ones are for rows that may be among the nearest
    with np.errstate(over="ignore", invalid="ignore"):
        square, own = (x * x).sum(axis=1), (q * q).sum(axis=1)
        rough = square + own[:, None] - 2 * (q @ x.T)
        slack = 16 * (x.shape[1] + 16) * np.finfo(np.float64).eps * (square.max() + own)
    for i, rows in enumerate(forest.candidates(q, least)):
        rows = rows[ids[rows] != query_ids[i]]
        if len(rows) > k:
            near = rough[i, rows]
            if np.isfinite(near).all() and np.isfinite(slack[i]):
                rows = rows[near <= np.partition(near, k - 1)[k - 1] + slack[i]]
        d = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
        if len(rows) > k:
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            rows, d = rows[near], d[near]
        best = np.lexsort((ids[rows], d))[:k]
        of.append(np.full(len(best), i))
        found.append(ids[rows[best]])
        score.append(d[best])
    return np.concatenate(of), np.concatenate(found), np.concatenate(score)


def merged(one: tuple, other: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row id, distance) of the k nearest of each query in either result."""
    of, found, score = (np.concatenate(c) for c in zip(one, other))
    order = np.lexsort((found, score, of))
    of, found, score = of[order], found[order], score[order]
    first = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[first], found[first], score[first]


def nearest(rows: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, candidates: int = CANDIDATES,
            block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows found of every row that ``is_query`` selects: query_id, rank (from 1), vec_id, score."""
    valid = rows.filter(usable("embedding") & F.col("vec_id").isNotNull())
    vectors = valid.select(F.col("embedding").alias("vector"), F.col("vec_id").cast("long").alias("id"),
                           F.lit(1).cast("long").alias("n"), is_query.alias("q"))
    data, _ = packed_blocks(vectors.drop("q"), block, "rows", PARTS)
    # a query is named by its id and vector
    asked = vectors.filter("q").drop("q").withColumn("n", F.xxhash64("vector")).dropDuplicates(["id", "n"])
    queries, _ = packed_blocks(asked, QUERY_BLOCK, "queries")
    a = queries.select(F.col("dim").alias("a_dim"), *(F.col(c).alias(f"a_{c}") for c in ("block", "ids", "ns", "data")))
    b = data.select("dim", *(F.col(c).alias(f"b_{c}") for c in ("block", "ids", "ns", "data")))
    # blocks of rows one after the other, each with all blocks of queries, so that its forest is built once
    visits = b.join(a.hint("shuffle_replicate_nl"), F.col("dim") == F.col("a_dim"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, forest, best = None, None, {}
        for batch in batches:
            for v in batch.to_pylist():
                if now != (v["dim"], v["b_block"]):
                    now = v["dim"], v["b_block"]
                    ids, _, x = unpack(v["dim"], v["b_ids"], v["b_ns"], v["b_data"])
                    forest = Forest(x, trees)
                own, key, q = unpack(v["dim"], v["a_ids"], v["a_ns"], v["a_data"])
                hits, of = search(forest, x, ids, q, own, k, candidates), (v["dim"], v["a_block"])
                best[of] = own, key, merged(best[of][2], hits, k) if of in best else hits
        for own, key, (of, found, score) in best.values():
            yield pa.RecordBatch.from_pydict({"query_id": own[of], "key": key[of], "vec_id": found, "score": score})

    met = visits.mapInArrow(visit, "query_id long, key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
