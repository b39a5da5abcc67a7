"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are scaled to length 1 and quantised to u = s q + e, with q in int8 and the length of e known exactly.
For two vectors u.v = s t (q.r) + (s q).f + e.v, so u.v is at most s t (q.r) + |s q| |f| + |e|. Tiles of q.r are
matrix products of small integers, exact in single precision; pairs whose bound reaches the threshold are
recomputed from the original vectors in double precision, and no other pair can link.

Exact copies are one class: they link to each other, and their class is compared once. Distinct vectors are
packed into blocks by hash, and each pair of blocks is one unit of work, whatever its vectors are; a unit returns
at most one row per vector (its number of links and the smallest vector it hangs together with there), so a
group of near copies never becomes a list of pairs.

Comparing all pairs is quadratic in the number of distinct vectors, as the exact result asks.

Null, zero and non-finite vectors, and rows with a null vec_id, link with nothing (component_id = vec_id, n_links
0). Rows that repeat a vec_id count as vectors of their own. Vectors of different lengths do not link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut
from tickloom.llm.components import components
from tickloom.llm.vectors import packed_blocks, paired, unpack, usable

THRESHOLD = 0.9
BLOCK, TILE = 8192, 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q (small integers as float32), s, |s q| and |e| of the vectors scaled to length 1."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    # the residual's length, with room for the rounding of this computation itself
    return q.astype(np.float32), s, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1) + 1e-12


def tile_links(xa: np.ndarray, xb: np.ndarray, qa: tuple, qb: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with cosine at least ``threshold``."""
    (pa_, sa, la, ea), (pb, sb, _, eb) = qa, qb
    dim = xa.shape[1]
    # integer sums below 2 ** 24 are exact in single precision
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
    product = pa_.astype(exact, copy=False) @ pb.astype(exact, copy=False).T
    product = product * (sa[:, None]).astype(exact) * sb[None, :].astype(exact)
    slack = 1e-6  # the rounding of the two scalings
    if float(product.max(initial=-2.0)) + float(la.max(initial=0) * eb.max(initial=0) + ea.max(initial=0)) + slack < threshold:
        return np.zeros(0, np.intp), np.zeros(0, np.intp)
    i, j = np.nonzero(product + (la[:, None] * eb[None, :] + ea[:, None]) + slack >= threshold)
    keep = np.zeros(len(i), bool)
    na, nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
    for a in range(0, len(i), 1 << 16):
        k = slice(a, a + (1 << 16))
        keep[k] = np.einsum("nd,nd->n", xa[i[k]], xb[j[k]]) / (na[i[k]] * nb[j[k]]) >= threshold
    return i[keep], j[keep]


def block_links(xa: np.ndarray, xb: np.ndarray, na: np.ndarray, nb: np.ndarray, same: bool, threshold: float = THRESHOLD,
                tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the vectors of two blocks (b's follow a's; the same block twice if ``same``): how many vectors each
    links with, and (vector, smaller vector it hangs together with) where that is not itself."""
    n = len(xa) if same else len(xa) + len(xb)
    shift = 0 if same else len(xa)
    links, parent = np.zeros(n, np.int64), np.arange(n)

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    quant_a = quantised(xa)
    quant_b = quant_a if same else quantised(xb)
    for a in range(0, len(xa), tile):
        rows = slice(a, a + tile)
        for b in range(a if same else 0, len(xb), tile):
            cols = slice(b, b + tile)
            i, j = tile_links(xa[rows], xb[cols], tuple(c[rows] for c in quant_a), tuple(c[cols] for c in quant_b), threshold)
            i, j = i + a, j + b
            if same and a == b:
                upper = i < j
                i, j = i[upper], j[upper]
            if not len(i):
                continue
            np.add.at(links, i, nb[j])
            np.add.at(links, j + shift, na[i])
            label = np.arange(n)
            while True:  # smallest label over this tile's links, until nothing changes
                low = np.minimum(label[i], label[j + shift])
                before = label.copy()
                np.minimum.at(label, i, low)
                np.minimum.at(label, j + shift, low)
                if (label == before).all():
                    break
            for v in np.flatnonzero(label != np.arange(n)).tolist():
                x, y = root(v), root(int(label[v]))
                parent[max(x, y)] = min(x, y)
    own = np.flatnonzero(links)
    return links, own, np.array([root(v) for v in own.tolist()], np.int64)


def cosine_links(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    ok = usable("embedding") & F.col("vec_id").isNotNull()
    marked = rows.select("vec_id", "embedding", ok.alias("ok"), F.xxhash64("embedding", F.lit(1)).alias("h1"),
                         F.xxhash64("embedding", F.lit(2)).alias("h2"))
    # h1 and h2 together name a distinct vector
    classes = cut(marked.filter("ok").groupBy("h1", "h2", "embedding")
                  .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")))
    blocks, per_dim = packed_blocks(classes.select(F.col("embedding").alias("vector"), F.col("h1").alias("id"), "n"),
                                    block, "vectors")
    units = paired(blocks, blocks, F.col("a_block"), F.lit(per_dim - 1).cast("long"))
    units = units.repartition(max(1, per_dim * (per_dim + 1) // 2), "dim", "a_block", "b_block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in batch.to_pylist():
                ids, na, xa = unpack(u["dim"], u["a_ids"], u["a_ns"], u["a_data"])
                other, nb, xb = unpack(u["dim"], u["b_ids"], u["b_ns"], u["b_data"])
                same = u["a_block"] == u["b_block"]
                links, own, roots = block_links(xa, xb, na, nb, same, threshold)
                every = ids if same else np.concatenate([ids, other])
                yield pa.RecordBatch.from_pydict({"id": every[own], "links": links[own], "root": every[roots]})

    found = cut(units.mapInArrow(compare, "id long, links long, root long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.filter("id <> root"), "id", "root")
    named = classes.select("h1", "h2", "first", "n").join(linked, F.col("h1") == F.col("id"), "left").drop("id")
    named = named.join(roots, F.col("h1") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "h1"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    alone = marked.select("vec_id", F.when(F.col("ok"), F.col("h1")).alias("h1"), F.when(F.col("ok"), F.col("h2")).alias("h2"))
    out = alone.join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
