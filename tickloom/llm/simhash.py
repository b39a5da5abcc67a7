"""SimHash near-duplicates found with pivot distance tables.

A text's fingerprint has a bit set where over half of its three-word shingles have it set in their hash.
Two fingerprints link at ``radius`` or fewer differing bits.

Candidate search: the bits are split into radius + 1 parts, so linked fingerprints agree wholly in at least
one part. For each part there is a table of Hamming distances, taken over that part, to reference
fingerprints; within an agreeing part the largest coordinate difference is 0, so the row of the table is an
equi-join key. Pairs that meet are discarded if a coordinate of the table over all bits differs by more
than ``radius`` (triangle inequality), and the survivors are verified on the fingerprints. Nothing is lost:
both tests are necessary conditions.

Only distinct fingerprints are joined, each with its smallest doc_id, so copies cost one row.

Null or empty text has fingerprint 0, linked like any other. Rows with a null doc_id take part; they name a
component only if all its ids are null (component_id null). Repeated rows share a fingerprint and a component.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, text_batches, utf8, written
from tickloom.llm.components import components

WORDS, SEED, RADIUS = 3, 42, 2
#: References per part and over all bits.
PART_PIVOTS, PIVOTS = 8, 6


def fingerprint(raw: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint. Words are runs of bytes other than space and 0x09-0x0D."""
    w = (raw or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    line = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.append(0, ends[:len(w) - words]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())),
                    np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprinted(text: Column | str = "text", words: int = WORDS, seed: int = SEED) -> Column:
    """Fingerprint column (as signed 64-bit) of a text column."""

    @F.arrow_udf("long")
    def fingerprints(arr: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t, words, seed) for t in utf8(arr)], np.uint64)
        return pa.array(found.view(np.int64))

    return fingerprints(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _distance(fp: Column, mask: int, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(pivot & mask))))


def linked_fingerprints(fps: DataFrame, radius: int = RADIUS, seed: int = 9) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints in column ``fp`` at most ``radius`` bits apart."""
    draw = random.Random(seed)
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    everything = (1 << 64) - 1
    fp = F.col("fp")
    rows = []
    for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
        mask = ((1 << (high - low)) - 1) << low
        row = F.lit(part).cast("long")
        for _ in range(PART_PIVOTS):  # distances within a part are below 64
            row = row * 64 + _distance(fp, mask, draw.getrandbits(64))
        rows.append(row)
    whole = [_distance(fp, everything, draw.getrandbits(64)).cast("byte").alias(f"d{i}") for i in range(PIVOTS)]
    table = fps.select("fp", *whole, F.explode(F.array(*rows)).alias("row"))
    a, b = table.alias("a"), table.alias("b")
    near = F.greatest(*(F.abs(F.col(f"a.d{i}") - F.col(f"b.d{i}")) for i in range(PIVOTS))) <= radius
    found = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.fp") < F.col("b.fp")) & near
                   & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius))
    return found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _components(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, root_fp) of the fingerprints in ``marked`` that link to a smaller one."""
    return components(linked_fingerprints(marked.select("fp").distinct(), radius), "a", "b")


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id
    reachable by links, its own included)."""
    marked = cut(text_batches(docs).select("doc_id", fingerprinted().alias("fp")))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = _components(marked, radius).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null ids last; of rows that
    share it, the one of the smallest fingerprint, and of full repeats any one). All columns are kept."""
    own = docs.columns
    # all columns in one struct, so no name can clash; the key is a struct, so a null id equals a null id
    key = F.struct(F.col("doc_id").alias("id"), fingerprinted().alias("fp")).alias("key")
    keyed = written(text_batches(docs).select(F.struct(*(docs[c] for c in own)).alias("row"), key), "fingerprints")
    marked = keyed.select("key.id", "key.fp")
    roots = _components(marked, radius).select(F.col("node").alias("fp"), "root")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "fp")
    classes = marked.groupBy("fp").agg(F.min(rank).alias("first")).join(roots, "fp", "left")
    keep = classes.groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("best")).select(F.struct("best.id", "best.fp").alias("key"))
    kept = keyed.join(keep, "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*(F.col("row")[c].alias(c) for c in own))
