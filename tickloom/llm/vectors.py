"""Blocks of vectors, packed for numpy work in tasks.

Vectors take part if they are not null, not zero, and hold neither nulls nor non-finite components. Vectors
of different lengths never meet: each length has blocks of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tickloom.llm.common import cut, written


def usable(vector: Column | str) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def packed_blocks(rows: DataFrame, size: int, name: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """Pack ``rows`` (vector, id: long, n: long) into blocks of about ``size`` rows, written once.

    Blocks: dim, block (from 0), ids, ns and data (little-endian bytes of longs, longs and floats or doubles, as the
    vectors are). A row's block is a hash of its vector and id, so no block grows with a common value. Returns the
    blocks and how many there are per dimension at most. With ``parts`` the blocks lie in so many partitions at most."""
    count = max(1, -(-rows.count() // size))
    single = rows.schema["vector"].dataType.elementType == FloatType()
    dealt = rows.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector", "id"), F.lit(count)).alias("block"),
                        "id", "n", F.col("vector").cast(f"array<{'float' if single else 'double'}>").alias("vector"))
    if parts:
        dealt = dealt.repartition(min(parts, count), "dim", "block")

    def pack(table: pa.Table) -> pa.Table:
        # in order of ids, so a rerun packs the same bytes
        table = table.combine_chunks().sort_by([("id", "ascending"), ("n", "ascending")])
        data = table["vector"].combine_chunks().flatten().to_numpy()
        one = lambda a, kind: pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())
        return pa.table({"dim": table["dim"][:1], "block": table["block"][:1], "ids": one(table["id"].to_numpy(), "<i8"),
                         "ns": one(table["n"].to_numpy(), "<i8"), "data": one(data, "<f4" if single else "<f8")})

    blocks = dealt.groupBy("dim", "block").applyInArrow(
        pack, "dim int, block long, ids binary, ns binary, data binary")
    return cut(blocks) if parts else written(blocks, name), count


def unpack(dim: int, ids: bytes, ns: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, ns = np.frombuffer(ids, "<i8"), np.frombuffer(ns, "<i8")
    return ids, ns, np.frombuffer(data, f"<f{len(data) // (dim * len(ids))}").reshape(-1, dim).astype(np.float64)


def paired(left: DataFrame, right: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every left block beside each right block numbered ``first`` to ``last``: dim, then a_ and b_ columns."""
    a = left.select("dim", *(F.col(c).alias(f"a_{c}") for c in ("block", "ids", "ns", "data")))
    wanted = a.withColumn("b_block", F.explode(F.sequence(first, last)))
    b = right.select(F.col("dim").alias("b_dim"), *(F.col(c).alias(f"b_{c}") for c in ("block", "ids", "ns", "data")))
    both = wanted.join(b.withColumnRenamed("b_block", "own"), (F.col("dim") == F.col("b_dim")) & (F.col("b_block") == F.col("own")))
    return both.drop("own", "b_dim")
