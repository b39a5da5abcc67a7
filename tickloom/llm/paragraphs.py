"""Substring deduplication by paragraph MinHash banding.

Every line that holds a word is a paragraph; so is a block of wrapped lines (between blank lines or the text's ends, all but
the last at most ``WRAPPED`` bytes long), whose near copies may be wrapped elsewhere. Each distinct paragraph gets a
MinHash signature over its five-word shingles, cut into bands; paragraphs that agree in a band collide. Collisions are
joined to stars around each band's smallest paragraph and so to candidate groups; within a group all paragraphs are
compared by exact Jaccard similarity of their shingles, and paragraphs at ``similarity`` or more are linked. Of every
connected component the first occurrence (smallest doc_id, then place) stays and the others are removals.

A passage may also lie inside longer lines or run over several. For these every window of ``window`` words counts as
a paragraph of its own, with the smallest hash of its five-word shingles as MinHash. Neighbouring windows mostly share
that shingle, so about 2 / ``window`` of the shingles are anchors. A passage of ``window`` words or more holds the
anchor of a window of its own, and ``segment`` words from the anchor on or up to its end; two places that share
the passage share such a segment word for word. Occurrences of a segment after its first are repeats, overlapping ones are
joined to stretches. A stretch may end inside a passage, so both ends are extended while the words agree with those around
the first place of the segment there. Runs of one repeated word are no passage.

With 12 bands of 4 a pair at similarity 0.8 collides with probability 0.998, one at 0.2 with 0.02.

Equal paragraphs are banded once a batch of texts and compared once, whatever the number of copies. A candidate group of many paragraphs is
split into blocks, and each pair of blocks is a unit of work of bounded size that returns a spanning forest, never
its pairs. Texts are read three times: for signatures, for segments, and for the words of colliding paragraphs and around stretches.

Words are runs of characters other than ASCII white space, A-Z lower-cased. Null or empty text has no paragraph.
Places are ordered by doc_id (null last), text and word. A row is named by its doc_id and a hash of its text, so rows with a
null doc_id, or that share one, are rows of their own; rows that repeat in full count as one, their paragraphs stay or go
together. A passage repeated inside a text goes as well, unless it overlaps its first occurrence. Very long texts are
taken whole. Paragraphs are named by a 128-bit hash of their words.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, text_batches, utf8, written
from tickloom.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
#: The longest line, in bytes, after which a text may have been wrapped.
WRAPPED = 120
WINDOW, SEGMENT = 50, 25
BLOCK = 256
#: Columns of an incidence matrix worked on together.
COLUMNS = 4096


@functools.lru_cache(maxsize=4)
def _multipliers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    n = bands * rows
    return (rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, n, dtype=np.uint64))


def shingles(words: list[bytes], n: int = SHINGLE) -> list[bytes]:
    if len(words) <= n:
        return [b" ".join(words)]
    return [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]


def _band_hashes(h: np.ndarray, mult: np.ndarray, add: np.ndarray, rows: int) -> np.ndarray:
    low = np.empty(len(mult), np.uint64)
    for a in range(0, len(h), 4096):  # a long paragraph in bounded memory
        m = (h[a:a + 4096, None] * mult + add).min(axis=0)
        low = m if a == 0 else np.minimum(low, m)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), seed=i) for i, band in enumerate(low.reshape(-1, rows))],
                    np.uint64).view(np.int64)


def banded_hashes(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of a set of shingle hashes."""
    return _band_hashes(h, *_multipliers(bands, rows), rows)


def paragraphs_of(raw: bytes) -> Iterator[tuple[int, bool, int, int]]:
    """(line number, is a block, first byte, end) of the lines with words and the wrapped blocks of a text."""
    at, block = 0, []
    for number, line in enumerate([*raw.split(b"\n"), b""]):
        if line and not line.isspace():
            yield number, False, at, at + len(line)
            block.append((number, at, at + len(line)))
        else:
            if len(block) > 1 and all(end - start <= WRAPPED for _, start, end in block[:-1]):
                yield block[0][0], True, block[0][1], block[-1][2]
            block = []
        at += len(line) + 1


def signatures(h: np.ndarray, first: np.ndarray, end: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of every paragraph: words ``first`` to ``end`` of a text whose words' hashes are ``h``."""
    mult, add = _multipliers(bands, rows)
    low = np.full((len(first), bands * rows), np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        short = end - first <= SHINGLE
        low[short] = _hashes(h, first[short], end[short])[:, None] * mult + add
        at = np.arange(max(0, len(h) - SHINGLE + 1))
        grams = _hashes(h, at, at + SHINGLE)
        # paragraphs in order that do not overlap: all at once; shingles across two of them fall between
        rest = np.flatnonzero(~short)
        step, done = 1 << 14, 0
        while done < len(rest):
            last = done + 1
            while last < len(rest) and first[rest[last]] >= end[rest[last - 1]] and end[rest[last]] - first[rest[done]] <= step:
                last += 1
            own = rest[done:last]
            a, b = first[own[0]], end[own[-1]] - SHINGLE + 1
            if last == done + 1:  # perhaps very long
                for c in range(a, b, step):
                    low[own[0]] = np.minimum(low[own[0]], (grams[c:min(b, c + step), None] * mult + add).min(axis=0))
            else:
                hashed = np.full((b - a + 1, len(mult)), np.uint64(2**64 - 1))
                hashed[:-1] = grams[a:b, None] * mult + add
                edges = np.column_stack([first[own], end[own] - SHINGLE + 1]).reshape(-1) - a
                low[own] = np.minimum.reduceat(hashed, edges, axis=0)[::2]
            done = last
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, (len(first), bands)).copy()
        for r in range(rows):
            out ^= low[:, r::rows]
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def row_name(doc_id: str, text: str) -> Column:
    """Tells rows of one doc_id, or without one, apart."""
    return F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))


def named(docs: DataFrame) -> DataFrame:
    """doc_id, row and text."""
    return docs.select("doc_id", row_name("doc_id", "text").alias("row"), "text")


def occurrences(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every paragraph: doc_id, row, paragraph (line number), block, start, end (code points), n_words, key, bands (null
    where an equal paragraph has them)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out, keys, bands_, blocks, known = [], [], [], [], [], set()
            for i, raw in enumerate(utf8(batch.column("text"))):
                parts = list(paragraphs_of(raw or b""))
                if not parts:
                    continue
                chars, low = _characters(raw), raw.lower()
                ws, _, h = words_of(raw)
                first = np.searchsorted(ws, [a for *_, a, _ in parts])
                end = np.searchsorted(ws, [b for *_, b in parts])
                marks = signatures(h, first, end, bands, rows)
                for (number, is_block, a, b), n, mark in zip(parts, (end - first).tolist(), marks):
                    if n < SHINGLE + 3:  # up to three shingles: 0.8 asks for equal sets, which agree in any band
                        mark = mark[:1]
                    key = xxhash.xxh3_128_digest(b" ".join(low[a:b].split()))
                    out.append((i, number, chars[a], chars[b], n))
                    blocks.append(is_block)
                    keys.append(key)
                    # equal words have equal bands: said once a batch
                    bands_.append(None if key in known else mark)
                    known.add(key)
            of, number, start, end, n = np.array(out, np.int64).reshape(-1, 5).T
            take = pa.array(of)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(take), "row": batch.column("row").take(take), "paragraph": number,
                "block": pa.array(blocks, pa.bool_()), "start": start, "end": end, "n_words": n,
                "key": pa.array(keys, pa.binary()), "bands": pa.array(bands_, pa.list_(pa.int64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return named(docs).mapInArrow(find, f"doc_id {kind}, row long, paragraph long, block boolean, start long, end long, "
                                        "n_words long, key binary, bands array<bigint>")


def _characters(raw: bytes) -> np.ndarray:
    """Characters before each byte, and in all."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=out[1:])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


@functools.lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash's base and of its inverse, modulo 2 ** 64."""
    power, back = np.ones(n, np.uint64), np.ones(n, np.uint64)
    power[1:], back[1:] = _ODD, _INVERSE
    return np.multiply.accumulate(power), np.multiply.accumulate(back)


def _hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the stretches [first, end) of a sequence, from one running sum."""
    power, back = _powers(1 << max(16, len(values).bit_length()))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=total[1:])
    x = (total[end] - total[first]) * back[first]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def words_of(raw: bytes) -> tuple[np.ndarray, ...]:
    """First byte, end and hash of every word of a text."""
    b = np.frombuffer(raw.lower(), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        return ws, we, _hashes(b.astype(np.uint64) + np.uint64(1), ws, we)


def _places(raw: bytes, ws: np.ndarray, we: np.ndarray, h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """``size`` words from each of the words ``first`` on: first word, start and end (code points), key; runs of one word left out."""
    turns = np.cumsum(np.append(False, h[1:] != h[:-1]))
    first = first[turns[first + size - 1] > turns[first]]
    with np.errstate(over="ignore"):
        keys = _hashes(h, first, first + size).view(np.int64)
    chars = _characters(raw)
    return first, chars[ws[first]], chars[we[first + size - 1]], keys


_NO_PLACES = (np.zeros(0, np.int64),) * 4


def segments_of(raw: bytes, window: int, segment: int) -> tuple[np.ndarray, ...]:
    """Anchored segments of one text: first word, start and end (code points), key (a polynomial hash of its words)."""
    ws, we, h = words_of(raw)
    n = len(ws)
    if n < window:
        return _NO_PLACES
    with np.errstate(over="ignore"):
        at = np.arange(n - SHINGLE + 1)
        grams = _hashes(h, at, at + SHINGLE)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - SHINGLE + 1)
    anchor = np.concatenate([view[a:a + 65536].argmin(axis=1) + np.arange(a, min(a + 65536, len(view)))
                             for a in range(0, len(view), 65536)])
    anchor = anchor[np.append(True, anchor[1:] != anchor[:-1])]
    up_to = segment - SHINGLE
    first = np.unique(np.concatenate([anchor[anchor + segment <= n], anchor[anchor >= up_to] - up_to]))
    return _places(raw, ws, we, h, first, segment)


#: What is asked of a row: the words of a paragraph, or the words before or after a place.
PARAGRAPH, BEFORE, AFTER = range(3)


def read(docs: DataFrame, asked: DataFrame, reach: int) -> DataFrame:
    """Answers to ``asked`` (doc_id, row, kind, at, block) from the texts, each read once for all that is asked of it: these
    columns, ``words`` (a paragraph's words; or hashes of up to ``reach`` words, outwards from a place) and ``edges`` (the
    start, or end, of those in code points)."""
    lists = asked.distinct().groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(
        F.collect_list(F.struct("kind", "at", "block")).alias("asked"))
    rows = named(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))).drop("_d", "_r")

    def answer(raw: bytes, asked: list[dict]) -> Iterator[tuple]:
        low, own = raw.lower(), {}
        if any(q["kind"] == PARAGRAPH for q in asked):
            own = {(number, is_block): (a, b) for number, is_block, a, b in paragraphs_of(low)}
        if any(q["kind"] != PARAGRAPH for q in asked):
            (ws, we, h), chars = words_of(raw), _characters(raw)
        for q in asked:
            at = q["at"]
            if q["kind"] == PARAGRAPH:
                a, b = own[at, q["block"]]
                yield q["kind"], at, q["block"], b" ".join(low[a:b].split()), None
            elif q["kind"] == BEFORE:
                words = np.arange(at - 1, max(-1, at - 1 - reach), -1)
                yield q["kind"], at, False, h[words].tobytes(), chars[ws[words]].astype(np.int32).tobytes()
            else:
                words = np.arange(at, min(len(ws), at + reach))
                yield q["kind"], at, False, h[words].tobytes(), chars[we[words]].astype(np.int32).tobytes()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [], []
            for i, (raw, questions) in enumerate(zip(utf8(batch.column("text")), batch.column("asked").to_pylist())):
                answers = list(answer(raw or b"", questions))
                out += answers
                of += [i] * len(answers)
            kinds, at, block, words, edges = zip(*out) if out else ((),) * 5
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(take), "row": batch.column("row").take(take), "kind": pa.array(kinds, pa.int32()),
                "at": pa.array(at, pa.int64()), "block": pa.array(block, pa.bool_()), "words": pa.array(words, pa.binary()),
                "edges": pa.array(edges, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    answers = rows.mapInArrow(find, f"doc_id {kind}, row long, kind int, at long, block boolean, words binary, edges binary")
    return written(answers.dropDuplicates(["doc_id", "row", "kind", "at", "block"]), "answers")


_PLACES = (np.zeros(0, np.int64),) * 4


def segments_of(raw: bytes, window: int, segment: int) -> tuple[np.ndarray, ...]:
    """Anchored segments of one text: first word, start and end (code points), key (a polynomial hash of its words)."""
    ws, we, h = words_of(raw)
    n = len(ws)
    if n < window:
        return _NO_PLACES
    with np.errstate(over="ignore"):
        at = np.arange(n - SHINGLE + 1)
        grams = _hashes(h, at, at + SHINGLE)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - SHINGLE + 1)
    anchor = np.concatenate([view[a:a + 65536].argmin(axis=1) + np.arange(a, min(a + 65536, len(view)))
                             for a in range(0, len(view), 65536)])
    anchor = anchor[np.append(True, anchor[1:] != anchor[:-1])]
    up_to = segment - SHINGLE
    first = np.unique(np.concatenate([anchor[anchor + segment <= n], anchor[anchor >= up_to] - up_to]))
    return _places(raw, ws, we, h, first, segment)


def windows_of(raw: bytes, spans: list[dict], window: int) -> tuple[np.ndarray, ...]:
    """All windows of one text whose first word lies in one of ``spans`` (low and high, inclusive), as segments_of."""
    ws, we, h = words_of(raw)
    last = len(ws) - window
    ranges = [np.arange(max(0, s["low"]), min(last, s["high"]) + 1) for s in spans]
    first = np.unique(np.concatenate(ranges)) if ranges else np.zeros(0, np.int64)
    return _places(raw, ws, we, h, first, window) if len(first) else _NO_PLACES


_PLACES = "row long, word int, start int, end int, key long"


def _place_batches(batches: Iterator[pa.RecordBatch], places: Callable[..., tuple], *columns: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inputs = [utf8(batch.column("text")), *(batch.column(c).to_pylist() for c in columns)]
        found = [places(raw or b"", *rest) for raw, *rest in zip(*inputs)]
        if not found:
            continue
        take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        word, start, end = (np.concatenate([f[i] for f in found]).astype(np.int32) for i in range(3))
        key = np.concatenate([f[3] for f in found]).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(take), "row": batch.column("row").take(take),
                                          "word": word, "start": start, "end": end, "key": key})


def _segments(docs: DataFrame, window: int, segment: int) -> DataFrame:
    """doc_id, row, word, start, end, key of every anchored segment."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return named(docs).mapInArrow(
        lambda batches: _place_batches(batches, lambda raw: segments_of(raw, window, segment)), f"doc_id {kind}, {_PLACES}")


def _repeated(places: DataFrame, size: int, name: str) -> DataFrame:
    """The places whose words stand at several, with ``low``, the first of them, and ``later``: not the first, nor
    overlapping it."""
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "word")
    own = places.groupBy("key").agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low < high")
    # written first: a key that very many places share can then be dealt out by the join
    shared = written(own.select("key", "low"), f"{name}-keys")
    same = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("row") == F.col("low.row"))
    later = (at > F.col("low")) & ~(same & (F.col("word") < F.col("low.word") + size))
    return places.join(shared, "key").withColumn("later", later)


def _islands(places: DataFrame) -> DataFrame:
    """``places`` (doc_id, row, word, stop) with a number for each stretch of overlapping or touching ones of a row."""
    order = Window.partitionBy("doc_id", "row").orderBy("word", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("word") > before, F.lit(True)).cast("long")
    return places.withColumn("_fresh", fresh).withColumn("_stretch", F.sum("_fresh").over(order)).drop("_fresh")


def stretches_of(docs: DataFrame, window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """Joined segments that stand at an earlier place: doc_id, row, first and last (words, end exclusive), start, end, low
    (the first place of any of them), head and tail (where the first and the last of them stand first)."""
    found = written(_segments(text_batches(docs), window, segment), "segments")
    later = _repeated(found, segment, "segments").filter("later").distinct().withColumn("stop", F.col("word") + segment)
    end = F.col("low").withField("word", F.col("low.word") + segment)
    return written(_islands(later).groupBy("doc_id", "row", "_stretch").agg(
        F.min("word").alias("first"), F.max("stop").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("low").alias("low"), F.min_by("low", "word").alias("head"), F.max_by(end, "word").alias("tail")).drop("_stretch"), "stretches")


def around(stretches: DataFrame) -> DataFrame:
    """What has to be read to extend ``stretches``: the words by both ends, of the stretch and of its first places."""
    sides = [("doc_id", "row", "first", BEFORE), ("head.doc_id", "head.row", "head.word", BEFORE),
             ("doc_id", "row", "last", AFTER), ("tail.doc_id", "tail.row", "tail.word", AFTER)]
    out = None
    for doc, row, at, kind in sides:
        one = stretches.select(F.col(doc).alias("doc_id"), F.col(row).alias("row"), F.lit(kind).alias("kind"),
                               F.col(at).cast("long").alias("at"), F.lit(False).alias("block"))
        out = one if out is None else out.unionByName(one)
    return out


def extended(stretches: DataFrame, answers: DataFrame) -> DataFrame:
    """``stretches`` up to where the words part from those of their first places: doc_id, row, start, end, n_words, kept_doc_id."""
    def read_at(rows: DataFrame, doc: str, row: str, at: str, kind: int, name: str) -> DataFrame:
        a = answers.filter(F.col("kind") == kind).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("at").alias("_a"),
                                                         F.struct("words", "edges").alias(name))
        same = F.col(doc).eqNullSafe(F.col("_d")) & (F.col(row) == F.col("_r")) & (F.col(at).cast("long") == F.col("_a"))
        return rows.join(a, same, "left").drop("_d", "_r", "_a")

    @F.arrow_udf("struct<n:int,edge:int>")
    def agreeing(mine: pa.Array, edges: pa.Array, other: pa.Array) -> pa.Array:
        out = []
        for a, e, b in zip(mine.to_pylist(), edges.to_pylist(), other.to_pylist()):
            x, y = np.frombuffer(a or b"", np.uint64), np.frombuffer(b or b"", np.uint64)
            m = min(len(x), len(y))
            parts = np.flatnonzero(x[:m] != y[:m])
            n = int(parts[0]) if len(parts) else m
            out.append({"n": n, "edge": int(np.frombuffer(e, np.int32)[n - 1]) if n else None})
        return pa.array(out, pa.struct([("n", pa.int32()), ("edge", pa.int32())]))

    rows = stretches
    for doc, row, at, kind, name in (("doc_id", "row", "first", BEFORE, "b1"), ("head.doc_id", "head.row", "head.word", BEFORE, "b2"),
                                     ("doc_id", "row", "last", AFTER, "a1"), ("tail.doc_id", "tail.row", "tail.word", AFTER, "a2")):
        rows = read_at(rows, doc, row, at, kind, name)
    rows = rows.withColumns({"before": agreeing("b1.words", "b1.edges", "b2.words"), "after": agreeing("a1.words", "a1.edges", "a2.words")})
    # within one text the words before a repeat may be the first occurrence itself
    own = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row") == F.col("head.row"))
    n = F.when(own, 0).otherwise(F.col("before.n"))
    wide = rows.select("doc_id", "row", (F.col("first") - n).alias("word"), (F.col("last") + F.col("after.n")).alias("stop"),
                       F.when(n > 0, F.col("before.edge")).otherwise(F.col("start")).alias("start"),
                       F.when(F.col("after.n") > 0, F.col("after.edge")).otherwise(F.col("end")).alias("end"), "low")
    return _islands(wide).groupBy("doc_id", "row", "_stretch").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"),
        (F.max("stop") - F.min("word")).cast("long").alias("n_words"), F.min("low").alias("low")).select(
        "doc_id", "row", "start", "end", "n_words", F.col("low.doc_id").alias("kept_doc_id"))


def repeated_segments(docs: DataFrame, window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """Stretches that stand at an earlier place as well: doc_id, row, start, end, n_words, kept_doc_id."""
    stretches = stretches_of(docs, window, segment)
    return extended(stretches, read(text_batches(docs), around(stretches), window - segment + 1))


def similar(texts: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of texts whose five-word shingle sets have that Jaccard similarity or more."""
    sets = [set(shingles(t.split())) for t in texts]
    shared: dict[bytes, int] = {}
    for s in sets:
        for x in s:
            shared[x] = shared.get(x, 0) + 1
    number = {x: i for i, x in enumerate(x for x, n in shared.items() if n > 1)}
    own = [np.array([number[x] for x in s if x in number], np.intp) for s in sets]
    return close(np.array([len(s) for s in sets]), own, len(number), similarity)


def close(size: np.ndarray, own: list[np.ndarray], shared: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of similar sets of ``size`` members, ``own`` being the numbers of those members (of
    ``shared`` in all) that several sets hold."""
    common = np.zeros((len(size), len(size)), np.float32)
    for a in range(0, shared, COLUMNS):
        part = np.zeros((len(size), min(COLUMNS, shared - a)), np.float32)
        for i, x in enumerate(own):
            part[i, x[(x >= a) & (x < a + COLUMNS)] - a] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    return np.nonzero(np.triu(common >= similarity * union - 1e-9, 1))


def _forest(keys: list[bytes], texts: list[bytes], similarity: float, pairs: Callable) -> Iterator[tuple[bytes, bytes]]:
    """(key, smallest key it hangs together with) of the paragraphs of one unit."""
    i, j = pairs(texts, similarity)
    if not len(i):
        return
    order = np.argsort(np.array(keys, object), kind="stable")
    rank = np.empty(len(keys), np.intp)
    rank[order] = np.arange(len(keys))
    i, j = rank[i], rank[j]
    label = np.arange(len(keys))
    while True:
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    for k in np.flatnonzero(label != np.arange(len(keys))):
        yield keys[order[k]], keys[order[label[k]]]


def verified(members: DataFrame, similarity: float, block: int, pairs: Callable = similar) -> DataFrame:
    """Spanning edges (a, b) of the links that ``pairs`` finds among ``members`` (group, key, words, size)."""
    n = F.ceil(F.col("size") / block).cast("long")
    dealt = members.select("group", "key", "words", n.alias("n"), F.pmod(F.xxhash64("key"), n).alias("x"))
    units = dealt.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "group", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "key", "words")
    unit = ["group", "x", "y"]
    units = units.repartition(*unit).sortWithinPartitions(*unit)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, texts, out = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                out.extend(_forest(keys, texts, similarity, pairs))
            keys.clear()
            texts.clear()
            if len(out) >= 10_000 or now is None:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.binary()),
                                                  "b": pa.array([y for _, y in out], pa.binary())})
                out.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*unit, "key", "words"))):
                if row[:3] != now:
                    if now is not None:
                        yield from flush()
                    now = row[:3]
                keys.append(row[3])
                texts.append(row[4])
        if now is not None:
            yield from flush()
        now = None
        yield from flush()

    return units.mapInArrow(compare, "a binary, b binary")


def removals(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
             window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """One row per paragraph or stretch to remove: doc_id, row, paragraph (its first line; null for a stretch), start, end,
    n_words, exact (equal words to the one kept), kept_doc_id and kept_paragraph (the occurrence that stays; together
    they name the component). A stretch may lie within or across removed lines, a line within a removed block."""
    docs = text_batches(docs)
    found = written(occurrences(docs, bands, rows), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "paragraph", "block")
    # candidate groups are found on short names; should two paragraphs share one, they are compared as well
    short = F.xxhash64("key").alias("short")
    classes = cut(found.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).select("*", short))
    # dealt by band once, for the stars and for the join with them
    banded = found.filter(F.col("bands").isNotNull()).select(short, F.explode("bands").alias("band")).repartition("band")
    stars = banded.groupBy("band").agg(F.min("short").alias("centre"), F.max("short").alias("other")).filter("centre <> other")
    met = banded.join(stars.select("band", "centre"), "band").filter("short <> centre")
    groups = components(met, "short", "centre")
    groups = groups.union(groups.select("root", "root").distinct())
    members = groups.join(classes, F.col("node") == F.col("short")).select(F.col("root").alias("group"), "key", "first")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    wanted = members.join(sizes, "group")
    wanted = cut(wanted)
    stretches = stretches_of(docs, window, segment)
    asked = wanted.select("first.doc_id", "first.row", F.lit(PARAGRAPH).alias("kind"), F.col("first.paragraph").alias("at"), "first.block")
    answers = read(docs, asked.unionByName(around(stretches)), window - segment + 1)
    texts = answers.filter(F.col("kind") == PARAGRAPH).select(
        F.col("doc_id").alias("own_doc"), F.col("row").alias("own_row"), "at", F.col("block").alias("own_block"), "words")
    members = wanted.join(texts, texts["own_doc"].eqNullSafe(F.col("first.doc_id")) & (texts["own_row"] == F.col("first.row"))
                          & (texts["at"] == F.col("first.paragraph")) & (texts["own_block"] == F.col("first.block")))
    links = components(verified(members, similarity, block), "a", "b")
    rooted = classes.select("key", "first", "copies").join(links, F.col("key") == F.col("node"), "left").select(
        "key", F.coalesce("root", "key").alias("root"), "first", "copies", F.col("root").isNotNull().alias("linked"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("kept"), F.min_by("key", "first").alias("kept_key"),
                                       F.sum("copies").alias("n")).filter("n > 1")
    removed = cut(rooted.join(heads, "root").select("key", "kept", (F.col("key") == F.col("kept_key")).alias("exact")))
    out = found.drop("bands").join(removed, "key").filter(~place.eqNullSafe(F.col("kept")))
    lines = out.select("doc_id", "row", "paragraph", "start", "end", "n_words", "exact",
                       F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.paragraph").alias("kept_paragraph"))
    none = F.lit(None).cast("long")
    longer = extended(stretches, answers).select(
        "doc_id", "row", none.alias("paragraph"), "start", "end", "n_words", F.lit(True).alias("exact"), "kept_doc_id",
        none.alias("kept_paragraph"))
    return lines.unionByName(longer)


def cleaned(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the paragraphs of ``found`` (the result of ``removals``) cut out of the texts; all rows stay."""
    spans = found.groupBy(F.col("doc_id").alias("_own"), F.col("row").alias("_own_row")).agg(F.array_sort(F.collect_set(
        F.struct("start", (F.col("end") + F.col("paragraph").isNotNull().cast("long")).alias("end")))).alias("_cut"))
    own = docs.columns
    # all columns in one struct, so no name can clash
    rows = text_batches(docs).select(F.struct(*(docs[c] for c in own)).alias("_row"), F.struct("doc_id", "text").alias("_of"))
    both = rows.withColumn("_mark", row_name("_of.doc_id", "_of.text")).join(
        spans, F.col("_of.doc_id").eqNullSafe(F.col("_own")) & (F.col("_mark") == F.col("_own_row")), "left")

    @F.arrow_udf("string")
    def without(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, spans_ in zip(text.to_pylist(), cuts.to_pylist()):
            if t is not None and spans_:
                parts, at = [], 0
                for s in spans_:  # a line goes with its line end
                    parts.append(t[at:max(at, s["start"])])
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    text = F.when(F.col("_cut").isNull(), F.col("_of.text")).otherwise(without("_of.text", "_cut"))
    return both.select(*((text if c == "text" else F.col("_row")[c]).alias(c) for c in own))
