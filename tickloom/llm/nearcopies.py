"""Near copies of whole texts: SimHash fingerprints found with pivot distance tables, and MinHash banding over
five-word shingles, verified by exact Jaccard similarity, for copies whose fingerprints are further apart.

Texts link whose fingerprints link as in ``simhash`` (three-word shingles, ``radius`` differing bits or fewer). For the
others each distinct text gets one hash per band; texts that agree in a band are candidates. Candidates are joined to
stars around each band's smallest text and so to groups; within a group all texts are compared by the exact
Jaccard similarity of their shingle sets, in blocks of bounded size. Texts at ``similarity`` or more link. Both kinds of
links make the groups, of which one document stays.

With 30 bands of 5 a pair at similarity 0.8 is missed with probability 7e-6, one at 0.9 with 1e-12; a pair at 0.3
meets with probability 0.07. A search by SimHash would have to reach 11 bits and more of 64, where parts of
five bits hold 32 values and so nearly all pairs meet.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer than five words is one
shingle. Shingles are compared by 64-bit hashes, texts are named by a 128-bit hash of their words. Texts without
words (null ones as well) are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, text_batches, utf8, written
from tickloom.llm.components import components
from tickloom.llm.paragraphs import BLOCK, SHINGLE, SIMILARITY, banded_hashes, close, verified
from tickloom.llm.simhash import RADIUS, fingerprint, linked_fingerprints

BANDS, ROWS = 30, 5


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words))], np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:len(words) - SHINGLE]).tolist()
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())),
                                 np.uint64, len(starts)))


def _marks(text: Column, bands: int, rows: int) -> Column:
    """key (of the words), bands and fingerprint of a text."""

    @F.arrow_udf("key binary, bands array<bigint>, fp bigint")
    def marks(arr: pa.Array) -> pa.Array:
        keys, found, fps = [], [], []
        for raw in utf8(arr):
            words = (raw or b"").lower().split()
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            found.append(banded_hashes(shingle_set(words), bands, rows))
            fps.append(fingerprint(raw))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())),
                                           pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "bands", "fp"])

    return marks(text)


def _sets(text: Column) -> Column:
    @F.arrow_udf("binary")
    def sets(arr: pa.Array) -> pa.Array:
        return pa.array([shingle_set((raw or b"").lower().split()).tobytes() for raw in utf8(arr)], pa.binary())

    return sets(text)


def similar_sets(raws: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of shingle sets with that Jaccard similarity or more."""
    sets = [np.frombuffer(raw, np.uint64) for raw in raws]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]
    own = [np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in sets]
    return close(np.array([len(s) for s in sets]), own, len(shared), similarity)


def _fingerprint_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of the texts in ``classes`` (key, fp) whose fingerprints link: those of one fingerprint with its
    smallest key, and such keys with each other."""
    least = classes.groupBy("fp").agg(F.min("key").alias("a"))
    same = classes.join(least, "fp").filter("key <> a").select("a", F.col("key").alias("b"))
    near = linked_fingerprints(least.select("fp"), radius).withColumnsRenamed({"a": "_a", "b": "_b"})
    ends = near.join(least.withColumnRenamed("fp", "_a"), "_a").join(least.select(F.col("fp").alias("_b"), F.col("a").alias("b")), "_b")
    return same.union(ends.select("a", "b"))


def first_of_near(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                  block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id (null ids last; of rows that
    share it, the one of the smallest key, and of full repeats any one). All columns are kept."""
    own = docs.columns
    # all columns in one struct, so no name can clash; the name is a struct, so a null id equals a null id
    marked = text_batches(docs).select(F.struct(*(docs[c] for c in own)).alias("row"), F.col("doc_id").alias("id"),
                                       _marks(docs["text"], bands, rows).alias("mark"))
    keyed = written(marked.select("row", F.struct("id", "mark.key").alias("name"), "mark.bands", "mark.fp"), "marks")
    rank = F.struct(F.col("name.id").isNull().alias("last"), "name.id", "name.key")
    classes = cut(keyed.groupBy(F.col("name.key").alias("key")).agg(F.min(rank).alias("first"), F.first("fp").alias("fp")))
    banded = written(keyed.select("name.key", "bands").dropDuplicates(["key"]).select("key", F.explode("bands").alias("band")), "bands")
    stars = banded.groupBy("band").agg(F.min("key").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = banded.join(stars.select("band", "centre"), "band").filter("key <> centre")
    groups = components(met, "key", "centre")
    groups = groups.union(groups.select("root", "root").distinct())
    members = groups.join(classes, F.col("node") == F.col("key")).select(
        F.col("root").alias("group"), F.struct("first.id", "first.key").alias("name"))
    wanted = members.join(members.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "group")
    texts = keyed.select("name", F.col("row.text").alias("text")).join(cut(wanted), "name").dropDuplicates(["name"])
    links = verified(texts.select("group", "name.key", _sets(F.col("text")).alias("words"), "size"), similarity, block, similar_sets)
    links = links.union(_fingerprint_links(classes.select("key", "fp"), radius))
    roots = components(links, "a", "b").select(F.col("node").alias("key"), "root")
    keep = classes.join(roots, "key", "left").groupBy(F.coalesce("root", "key")).agg(F.min("first").alias("best"))
    keep = keep.select(F.struct("best.id", "best.key").alias("name"))
    kept = keyed.select("row", "name").join(keep, "name", "left_semi").dropDuplicates(["name"])
    return kept.select(*(F.col("row")[c].alias(c) for c in own))
