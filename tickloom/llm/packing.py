"""Mixture-controlled packing of token streams into fixed windows by deficit round-robin.

Every source has a queue of its documents' tokens. Rounds of about one window each serve all queues; over
r rounds a queue of T tokens has been owed r * T / R tokens (R rounds in all) and has been served the whole
part of that, so its deficit is the fraction below one token that is carried on. The served tokens, round by
round, are one stream that is cut into windows of 2048. Each window therefore holds every source within a
few tokens of its share (the rounding of its two rounds, and 2048 / R tokens by which a round is short of a window), all queues run dry together, and the deficit before any round is known in closed
form: partitions of the data need no state from each other.

Sources with less than ``min_share`` of all tokens are grouped, ``fan`` at a time by size, where there are more than
``fan`` of them, and groups again until ``fan`` are left. A group is one queue of the rounds; its own stream is made
by the same rounds over its members, so a window holds every source in proportion, within a few rounds' tokens of the
source for each level. At most 1 / min_share + fan queues and their sizes come to the driver; the members of a group
go with the rows of its sources.

The last, incomplete window is cut into sequences whose lengths are powers of two, so nothing is padded.

Null text counts as empty (its document is the end token alone); a null source is a source of its own.
Repeated rows are packed as often as they occur. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, portions, text_batches, written

LENGTH = 2048
MIN_SHARE, FAN = 1 / 256, 256
END = 1
#: Characters encoded, and tokens cut, together.
PORTION, CUT_TOKENS = 1 << 21, 1 << 20
#: Rows of a matrix rounds x queues worked on together.
ROUNDS_TOGETHER = 4096


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    """Byte-level BPE of a ranks file; gives the ids of the same vocabulary's ``tokenizers`` file."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens(vocabulary))


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of the ``tokenizers`` file beside a ranks file; none if there is no such file."""
    beside = os.path.splitext(vocabulary)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def encoded(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text, added tokens as the ``tokenizers`` file takes them."""
    if any(t in text for t in enc.special_tokens_set):
        return enc.encode(text, allowed_special="all")
    return enc.encode_ordinary(text)


def _tokens(docs: DataFrame, vocabulary: str, pattern: str, end: int) -> DataFrame:
    """doc_id, source, n_tokens, part (input partition), ahead (tokens of the source before the document
    within the partition), ids (little-endian 16-bit)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary, pattern)
        part = TaskContext.get().partitionId()
        ahead: dict[str | None, int] = {}
        for batch in batches:
            sources, texts = batch.column("source").to_pylist(), batch.column("text").to_pylist()
            for a, b in portions([len(t or "") for t in texts], PORTION):
                rows = []
                for source, text in zip(sources[a:b], texts[a:b]):
                    ids = encoded(enc, text or "")
                    ids.append(end)
                    done = ahead.get(source, 0)
                    ahead[source] = done + len(ids)
                    rows.append((len(ids), done, np.array(ids, "<u2").tobytes()))
                n, before, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("source").slice(a, b - a),
                     pa.array(n, pa.int64()), pa.array([part] * (b - a), pa.int64()), pa.array(before, pa.int64()),
                     pa.array(ids, pa.binary())], names=["doc_id", "source", "n_tokens", "part", "ahead", "ids"])

    return text_batches(docs).select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(
        encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, n_tokens long, part long, ahead long, ids binary")


def served(rounds: np.ndarray, size: int | np.ndarray, total_rounds: int) -> np.ndarray:
    """floor(rounds * size / total_rounds) without overflow: tokens of a queue served before each round."""
    whole, rest = np.divmod(size, total_rounds)
    high, low = rounds >> 16, rounds & 0xFFFF
    q, m = np.divmod(high * rest, total_rounds)
    return rounds * whole + (q << 16) + ((m << 16) + low * rest) // total_rounds


def _cuts(queue: int, start: int, n: int, sizes: np.ndarray, total_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(place within the document, place in the stream) of each stretch the rounds take from a document
    that lies at ``start`` of its queue."""
    size = int(sizes[queue])

    def round_of(x: int) -> int:  # the last r with r * size // total_rounds <= x
        return min(((x + 1) * total_rounds - 1) // size, total_rounds - 1)

    low, high = round_of(start), round_of(start + n - 1)
    if high - low < n:
        rounds = np.arange(low, high + 1)
    else:  # most rounds take nothing: those that take each token
        rounds = np.unique(np.fromiter(map(round_of, range(start, start + n)), np.int64, n))
    base, own = [], []
    for a in range(0, len(rounds), ROUNDS_TOGETHER):
        r = rounds[a:a + ROUNDS_TOGETHER]
        matrix = served(r[:, None], sizes[None, :], total_rounds)
        following = served(r[:, None] + 1, sizes[None, :queue], total_rounds)
        base.append(matrix.sum(axis=1) + (following - matrix[:, :queue]).sum(axis=1))
        own.append(matrix[:, queue])
    base, own = np.concatenate(base), np.concatenate(own)
    first = np.maximum(own, start)
    keep = np.append(first[1:] > first[:-1], True) if len(first) > 1 else np.ones(1, bool)
    return (first - start)[keep], (base + first - own)[keep]


def _nested(levels: list[tuple[int, np.ndarray]], start: int, n: int, total_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``_cuts`` through the groups of a source, innermost first; the last level is the whole stream."""
    (queue, sizes), *outer = levels
    doc_at, at = _cuts(queue, start, n, sizes, total_rounds)
    for queue, sizes in outer:
        size = np.diff(np.append(doc_at, n))
        # stretches that follow each other in a group's stream are one
        new = np.append(True, at[1:] != at[:-1] + size[:-1])
        doc_at, at = doc_at[new], at[new]
        size = np.diff(np.append(doc_at, n))
        found = [_cuts(queue, int(a), int(m), sizes, total_rounds) for a, m in zip(at, size)]
        doc_at = np.concatenate([d + inner for d, (inner, _) in zip(doc_at, found)])
        at = np.concatenate([x for _, x in found])
    return doc_at, at


def _bounds(total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the sequences after the last full window, each a power of two long."""
    at, starts = total // length * length, []
    while at < total:
        starts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return np.array(starts, np.int64), np.array([*starts[1:], total] if starts else [], np.int64)


def place(levels: list[tuple[int, np.ndarray]], start: int, n: int, total_rounds: int, total: int, length: int):
    """Pieces of one document: start, length, sequence_id, offset (arrays). ``levels``: (queue, sizes) from the source's
    group to the whole stream."""
    doc_at, stream_at = _nested(levels, start, n, total_rounds)
    size = np.diff(np.append(doc_at, n))
    tail_start, tail_end = _bounds(total, length)
    full = total // length
    # a stretch of s tokens meets at most s // length + 2 windows, and the short last sequences
    ends = stream_at + size
    cut_from = np.repeat(np.arange(len(size)), (np.minimum(ends - 1, full * length - 1) // length - stream_at // length + 1).clip(0))
    step = np.arange(len(cut_from)) - np.searchsorted(cut_from, cut_from)
    window = stream_at[cut_from] // length + step
    pieces = [(cut_from, window, window * length, (window + 1) * length)]
    if len(tail_start) and ends.max() > full * length:
        i, j = np.nonzero((stream_at[:, None] < tail_end) & (ends[:, None] > tail_start))
        pieces.append((i, full + j, tail_start[j], tail_end[j]))
    own, seq, low, high = (np.concatenate(x) for x in zip(*pieces))
    a, b = np.maximum(stream_at[own], low), np.minimum(ends[own], high)
    order = np.argsort(a, kind="stable")
    own, seq, low, a, b = own[order], seq[order], low[order], a[order], b[order]
    return doc_at[own] + a - stream_at[own], b - a, seq, a - low


def _grouped(small: DataFrame, fan: int, above: int) -> tuple[DataFrame, list[int]]:
    """(own, queue, groups) of the sources in ``small`` (source, n), with groups from the innermost to the outermost, and
    the sizes of the at most ``fan`` queues they end in, which are numbered from ``above``."""
    by_size = Window.orderBy(F.desc("n"), "source")
    nodes = cut(small.select(F.col("source").alias("own"), (F.row_number().over(by_size) - 1).alias("node"), "n"))
    out = nodes.select("own", "node", F.expr("cast(array() as array<struct<queue:int,sizes:array<bigint>>>)").alias("groups"))
    nodes = nodes.drop("own")
    count = nodes.count()
    while count > fan:
        member = F.struct(F.expr(f"node % {fan}").alias("queue"), "n")
        nodes = cut(nodes.groupBy(F.expr(f"node div {fan}").cast("int").alias("node")).agg(
            F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(member)), lambda x: x["n"]).alias("sizes")))
        inner = nodes.select(F.col("node").alias("outer"), "sizes")
        out = out.join(inner, F.expr(f"node div {fan}") == F.col("outer")).select(
            "own", F.col("outer").alias("node"),
            F.concat("groups", F.array(F.struct(F.expr(f"node % {fan}").cast("int").alias("queue"), "sizes"))).alias("groups"))
        nodes = nodes.drop("sizes")
        count = -(-count // fan)
    tops = [r["n"] for r in nodes.orderBy("node").collect()]
    return out.select("own", (F.col("node") + above).cast("int").alias("queue"), "groups"), tops


def pack(docs: DataFrame, vocabulary: str, pattern: str, end: int = END, length: int = LENGTH,
         min_share: float = MIN_SHARE, with_ids: bool = True, fan: int = FAN) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, and, if
    asked for, ids (little-endian 16-bit).

    ``vocabulary`` is the path of a ranks file with ids below 65,536. The ids are written once to the shared
    checkpoint folder; only the sizes of (partition, source) are joined to them."""
    tokens = written(_tokens(docs, vocabulary, pattern, end), "tokens")
    parts = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    totals = parts.groupBy("source").agg(F.sum("n").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    large = totals.filter(F.col("n") >= min_share * total).orderBy(F.desc("n"), "source").collect()
    small = totals.filter(F.col("n") < min_share * total)
    small, tops = _grouped(small, fan, len(large))
    sizes = np.array([r["n"] for r in large] + tops, np.int64)
    rounds = max(1, -(-total // length))
    inner = "array<struct<queue:int,sizes:array<bigint>>>"
    queues = small
    if large:
        kind = "own string, queue int, groups " + inner
        direct = tokens.sparkSession.createDataFrame([(r["source"], i, []) for i, r in enumerate(large)], kind)
        queues = direct.unionByName(small)
    # where each partition's share of a queue begins
    ordered = Window.partitionBy("source").orderBy("part")
    begins = parts.select("source", F.col("part").alias("own_part"),
                          (F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("begin"))
    begins = begins.join(queues, begins["source"].eqNullSafe(queues["own"])).drop("source")
    begins = written(begins, "begins")  # its size is known then, and Spark joins it without a shuffle if it is small
    placed = tokens.join(begins, (tokens["part"] == begins["own_part"]) & tokens["source"].eqNullSafe(begins["own"]))
    placed = placed.select("doc_id", "source", "n_tokens", "queue", "groups", (F.col("begin") + F.col("ahead")).alias("at"), "ids")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, queue, groups, at, ids = (batch.column(c).to_pylist() for c in ("n_tokens", "queue", "groups", "at", "ids"))
            for a, b in portions(n_tokens, CUT_TOKENS):
                of, out, crcs, raws = [], [], [], []
                for i in range(a, b):
                    levels = [(g["queue"], np.array(g["sizes"], np.int64)) for g in groups[i]] + [(queue[i], sizes)]
                    cols = place(levels, at[i], n_tokens[i], rounds, total, length)
                    wide = np.frombuffer(ids[i], "<u2").astype("<u4")
                    of.append(np.full(len(cols[0]), i))
                    out.append(np.stack(cols))
                    for s, m in zip(cols[0].tolist(), cols[1].tolist()):
                        crcs.append(zlib.crc32(wide[s:s + m]))
                        if with_ids:
                            raws.append(ids[i][2 * s:2 * (s + m)])
                rows = pa.array(np.concatenate(of))
                start, size, seq, offset = np.concatenate(out, axis=1).astype(np.int64)
                columns = {
                    "doc_id": batch.column("doc_id").take(rows), "source": batch.column("source").take(rows),
                    "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array(crcs, pa.int64()),
                    "doc_tokens": batch.column("n_tokens").take(rows), "sequence_id": pa.array(seq),
                    "offset": pa.array(offset)}
                if with_ids:
                    columns["ids"] = pa.array(raws, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut_up, f"doc_id {kind}, source string, start long, length long, ids_crc32 long, "
                                     "doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
