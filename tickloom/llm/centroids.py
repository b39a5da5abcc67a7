"""Centroid clustering with a vantage-point tree over the centroids.

Vectors are integers, floor(scale * x), so distances, sums and means are exact and do not depend on how rows
are spread. Each round the driver builds a vantage-point tree over the centroids (number of clusters x
components, the only thing it ever holds) and broadcasts it. A vector descends best-first: of all open nodes the
one with the smallest possible distance is next, and the search ends when that exceeds the best distance found;
equal is not enough to stop, so that of equally near centroids the smaller number wins. Bounds are floating point with
room for their rounding; distances that decide are integers. Tasks add up their vectors per cluster before the
shuffle, so a cluster of any share of the rows is a few rows per task.

Rows take part whose vector has exactly ``dim`` components, none null or non-finite; others are not returned. Rows that
repeat a vec_id are vectors of their own; a null vec_id takes part and is chosen last as a start. With fewer vectors than clusters there
are as many clusters as vectors; an empty table gives an empty result. Integers are held within +-2**40
(components beyond are taken as that); a squared distance or a sum of them that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written

LARGEST = 1 << 40
LEAF = 4
#: Open bounds (vectors x nodes) that a task holds at a time.
BOUNDS = 1 << 21
_LONG = 2**63 - 1


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, broadcast over the last axis."""
    far = int(np.abs(x).max(initial=0)) + int(np.abs(y).max(initial=0))
    if far * far * x.shape[-1] >= 1 << 62:
        gap = x.astype(object) - y.astype(object)
        return (gap * gap).sum(axis=-1)
    gap = x - y
    return np.einsum("...d,...d->...", gap, gap)


@dataclass
class Node:
    """A ball around a vantage point; ``near`` and ``far`` are (node, least, largest distance to the point)."""

    members: np.ndarray  # centroids compared here: the vantage point alone, or a leaf's
    near: tuple[int, float, float] | None = None
    far: tuple[int, float, float] | None = None


@dataclass
class Tree:
    points: np.ndarray
    nodes: list[Node] = field(default_factory=list)


def build(points: np.ndarray) -> Tree:
    """A tree over the rows of ``points``: vantage points far out, split at the median distance."""
    tree = Tree(points)

    def grow(own: np.ndarray) -> int:
        at = len(tree.nodes)
        tree.nodes.append(Node(own))
        if len(own) <= LEAF:
            return at
        middle = points[own].mean(axis=0)
        vantage = own[int(np.square(points[own] - middle).sum(axis=1).argmax())]
        rest = own[own != vantage]
        away = np.sqrt(squared(points[rest], points[vantage]).astype(np.float64))
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        children = []
        for part in (order[:half], order[half:]):
            children.append((grow(np.sort(rest[part])), float(away[part].min()), float(away[part].max())))
        tree.nodes[at] = Node(np.array([vantage]), *children)
        return at

    grow(np.arange(len(points)))
    return tree


def nearest(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x``: the nearest point (of equally near ones the smallest) and the squared distance."""
    number = np.full(len(x), -1, np.int64)
    best = np.full(len(x), -1, object if len(x) and _wide(tree.points, x) else np.int64)
    block = max(1, BOUNDS // len(tree.nodes))
    for at in range(0, len(x), block):
        rows = slice(at, at + block)
        number[rows], best[rows] = _search(tree, x[rows])
    return number, best


def _wide(points: np.ndarray, x: np.ndarray) -> bool:
    far = int(np.abs(points).max(initial=0)) + int(np.abs(x).max(initial=0))
    return far * far * x.shape[1] >= 1 << 62


def _search(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    every = np.arange(len(x))
    number, best = np.full(len(x), -1, np.int64), np.zeros(len(x), object if _wide(tree.points, x) else np.int64)
    radius = np.full(len(x), np.inf)
    bound = np.full((len(x), len(tree.nodes)), np.inf)
    bound[:, 0] = 0.0
    active = every
    while len(active):
        step = bound[active].argmin(axis=1)
        low = bound[active, step]
        live = (low <= radius[active]) & (low < np.inf)  # inclusive: an equal distance may have a smaller number
        active, step, low = active[live], step[live], low[live]
        for n in np.unique(step).tolist():
            rows, floor = active[step == n], low[step == n]
            node = tree.nodes[n]
            bound[rows, n] = np.inf
            away = squared(x[rows][:, None, :], tree.points[node.members][None, :, :])
            pick = away.argmin(axis=1)  # members ascend, so the first of equals is the smallest
            d, c = away[np.arange(len(rows)), pick], node.members[pick]
            better = (number[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], c[better]
            radius[rows] = np.sqrt(best[rows].astype(np.float64))
            radius[rows] += 1e-9 * (1.0 + radius[rows])
            if node.near:
                to = np.sqrt(away[:, 0].astype(np.float64))
                for child, least, largest in (node.near, node.far):
                    slack = 1e-9 * (1.0 + to + largest)
                    gap = np.maximum(np.maximum(least - to, to - largest) - slack, 0.0)
                    bound[rows, child] = np.maximum(gap, floor)
    return number, best


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def integer_vectors(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v (integers) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.coalesce((F.size("embedding") == dim) & finite, F.lit(False))
    most = F.lit(float(LARGEST))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, most), -most)).cast("long"))
    return rows.filter(ok).select("vec_id", whole.alias("v"))


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id (at most k rows come to the driver)."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(draw.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def next_centroids(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """Every centroid's floored mean of the vectors nearest to it; a centroid without vectors stays."""
    dim = points.shape[1]
    tree = vectors.sparkSession.sparkContext.broadcast(build(points))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            number, _ = nearest(tree.value, x)
            own = np.unique(number)
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(own, pa.int64()), "n": pa.array([int((number == c).sum()) for c in own], pa.int64()),
                "sums": pa.array([x[number == c].sum(axis=0).tolist() for c in own], pa.list_(pa.int64()))})

    part = vectors.select("v").mapInArrow(partial, "cluster long, n long, sums array<long>")
    each = part.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    sums = each.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    moved = points.copy()
    for r in sums.collect():  # clusters x components
        moved[r.cluster, r["at"]] = int(r.s) // r.n
    tree.unpersist()
    return moved


def clusters(rows: DataFrame, k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3, seed: str = "1") -> DataFrame:
    """One row per vector of ``rows`` (vec_id, embedding) that takes part: vec_id, cluster, distance (squared),
    cluster_inertia, inertia, and centroid (the cluster's final integers)."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, dim, scale)
    points = starts(vectors, k, seed)
    if not len(points):
        return vectors.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))))
    for _ in range(rounds):
        points = next_centroids(vectors, points)
    tree = spark.sparkContext.broadcast(build(points))
    ids = vectors.schema["vec_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, best = nearest(tree.value, _matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number, pa.int32()),
                 pa.array([d if d <= _LONG else None for d in best.tolist()], pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = written(vectors.mapInArrow(assign, f"vec_id {ids}, cluster int, distance long"), "clusters")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
                                           F.count(F.lit(1)).alias("n"), F.count("distance").alias("m")).collect()

    def long(total: int) -> int | None:
        return total if total <= _LONG else None

    whole = all(r.n == r.m for r in sums)
    inertia = long(sum(int(r.s) for r in sums)) if whole else None
    named = [(r.cluster, long(int(r.s)) if r.n == r.m else None, inertia, points[r.cluster].tolist()) for r in sums]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # k rows, so the broadcast is bounded
    return assigned.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def oracle_sql(k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3, seed: str = "1") -> str:
    """The same clusters as one statement, every vector against every centroid."""
    steps = [f"""
        kept AS (SELECT row_number() OVER () AS rid, vec_id,
                        [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
                 FROM embeddings WHERE len(embedding) = {dim}
                   AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dim}),
        c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS centroid
               FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS (SELECT rid, min(d) AS d, arg_min(c, d * {k} + c) AS c
                 FROM (SELECT rid, c, list_sum([(v[i] - centroid[i]) * (v[i] - centroid[i])
                                                for i in range(1, {dim + 1})]) AS d FROM kept, c{r})
                 GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n
                 FROM (SELECT a{r}.c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept JOIN a{r} USING (rid)) GROUP BY c, i),
        m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS moved FROM s{r} GROUP BY c),
        c{r + 1} AS (SELECT c{r}.c, coalesce(moved, centroid) AS centroid FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""WITH {",".join(steps)}
        SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(centroid, ',')) AS centroid_sha256
        FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""


