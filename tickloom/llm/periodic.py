"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal) of at least ``FOLD`` q words that no
neighbouring word extends. Runs of period q are looked for at the dyadic scale t with t <= q < 2t:

* Every window of t words has a hash. A place i is *synchronising* if the smallest hash of the windows starting at
  i, i+1, ..., i+t is the first or the last one. Windows of period t/4 or less do not compete; they are exactly those inside runs
  of smaller scales, which are known by then (the highly periodic regions).
* The choice depends on the 2t words from i on alone, and each stretch of t places outside the highly periodic regions holds one.
  So in a run of period q some place i among the first t synchronises, i + q as well, with equal contexts of 2t
  words, and (as q < 2t) no equal context lies between them. Neighbours among equal contexts, t to 2t-1 apart,
  therefore propose every period of that scale, and only places * constant / t of them exist.
* Proposals are extended word by word on both sides; stretches of ``FOLD`` periods and more are runs. Words are
  compared themselves there, so a hash can propose in vain but never makes a run.

Small periods need no scale of their own: where a longer run is made of highly periodic stretches, its own scale
still synchronises at their borders, and inside one the smaller period is the run.

Texts are taken whole, many at a time; a text of n words costs about n log n. Null and empty texts have no words
and no runs; their collapsed text is empty. Repeated rows and null ids are handled each for themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import portions, text_batches, utf8

#: A run holds its period this often at least, and this many words at least.
FOLD, MIN_WORDS = 4, 6
#: Words that are searched together.
PORTION = 250_000
_NEVER = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """An invertible mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` values from each place on (shorter at the end)."""
    n = len(values)
    rows = -(-n // width) + 1
    grid = np.full((rows, width), _NEVER)
    grid.reshape(-1)[:n] = values
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _agreeing(equal_at, length: int) -> int:
    """How many of the first ``length`` places agree before one does not; looks at a few, then at ever more."""
    done, step = 0, 64
    while done < length:
        stop = min(length, done + step)
        differs = ~equal_at(done, stop)
        if differs.any():
            return done + int(differs.argmax())
        done, step = stop, step * 4
    return length


def _extended(words: np.ndarray, i: int, d: int, first: int, end: int) -> tuple[int, int]:
    """The largest stretch around place i of ``first``..``end`` in which words d apart are equal."""
    right = _agreeing(lambda a, b: words[i + a:i + b] == words[i + d + a:i + d + b], end - d - i)
    left = _agreeing(lambda a, b: words[i - b:i - a][::-1] == words[i + d - b:i + d - a][::-1], i - first)
    return i - left, i + right + d


def find_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of texts laid one after another (``sizes`` words each): rows (start, length, period), by start and period.

    Runs have ``FOLD`` periods at least; starts count from the first text."""
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    room = (ends[owner] - np.arange(len(words))).astype(np.int64)  # words from here to the text's end
    found: list[np.ndarray] = []
    hashes = _mixed((words.astype(np.uint64) + np.uint64(1)) * _ODD)
    t = 1
    while len(words) and FOLD * t <= int(sizes.max()):
        # windows of t words; those of small period, or past the text's end, do not compete
        compete = hashes.copy()
        compete[room < t] = _NEVER
        if found:
            known = np.concatenate(found)
            small = known[(known[:, 2] * 4 <= t) & (known[:, 1] >= t)]
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, small[:, 0], 1)
            np.add.at(step, small[:, 0] + small[:, 1] - t + 1, -1)
            compete[np.cumsum(step[:-1]) > 0] = _NEVER
        least = window_minima(compete, t + 1)
        last = np.full(len(words), _NEVER)
        last[:len(words) - t] = compete[t:]
        chosen = np.flatnonzero((room >= 2 * t) & (least != _NEVER) & ((compete == least) | (last == least)))

        after = np.zeros_like(hashes)
        after[:len(words) - t] = hashes[t:]
        hashes = _mixed(hashes * _ODD + after)  # windows of 2t words
        context = hashes[chosen]
        order = np.argsort(context, kind="stable")
        a, context = chosen[order], context[order]
        gap = a[1:] - a[:-1]
        near = (context[1:] == context[:-1]) & (gap >= t) & (gap < 2 * t)
        near &= room[a[:-1]] > gap  # in one text
        place, period = a[:-1][near], gap[near]

        # places with one period and overlapping contexts belong to one stretch
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        new = np.ones(len(place), bool)
        new[1:] = (period[1:] != period[:-1]) | (place[1:] - place[:-1] > 2 * t) | (owner[place[1:]] != owner[place[:-1]])
        runs = set()
        for i, d in zip(place[new].tolist(), period[new].tolist()):
            end = int(ends[owner[i]])
            start, stop = _extended(words, i, d, end - int(sizes[owner[i]]), end)
            if stop - start >= FOLD * d:
                runs.add((start, stop - start, d))
        if runs:
            found.append(np.array(sorted(runs), np.int64))
        t *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.concatenate(found)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def scan(texts: list[bytes | None]) -> list[dict]:
    """The runs and the collapsed text of each text."""
    split = [(t or b"").split() for t in texts]
    out: list[dict] = [{"runs": [], "collapsed": b" ".join(w)} for w in split]
    # texts of like length share their scales
    order = sorted((i for i, w in enumerate(split) if len(w) >= MIN_WORDS), key=lambda i: len(split[i]).bit_length())
    group: dict[int, list[int]] = {}
    for i in order:
        group.setdefault(len(split[i]).bit_length(), []).append(i)
    for members in group.values():
        for lo, hi in portions([len(split[i]) for i in members], PORTION):
            part = members[lo:hi]
            numbers: dict[bytes, int] = {}
            words = np.array([numbers.setdefault(w, len(numbers)) for i in part for w in split[i]], np.int64)
            sizes = np.array([len(split[i]) for i in part], np.int64)
            runs = find_runs(words, sizes)
            runs = runs[runs[:, 1] >= MIN_WORDS]
            firsts = np.cumsum(sizes) - sizes
            where = np.searchsorted(firsts, runs[:, 0], "right") - 1
            for k in np.unique(where).tolist():
                i, own = part[k], runs[where == k] - [firsts[k], 0, 0]
                gone = np.zeros(len(split[i]) + 1, np.int64)
                np.add.at(gone, own[:, 0] + own[:, 2], 1)
                np.add.at(gone, own[:, 0] + own[:, 1], -1)
                kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                out[i] = {"runs": [{"start": s, "length": n, "period": p} for s, n, p in own.tolist()],
                          "collapsed": b" ".join([split[i][x] for x in kept])}
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_DDL = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, runs (start, length and period in words, by start and period) and collapsed
    (the words that no run holds after its first period, joined by one space)."""

    @F.arrow_udf(_DDL)
    def found(text: pa.Array) -> pa.Array:
        rows = scan(utf8(text))
        runs = pa.array([r["runs"] for r in rows], pa.list_(_RUN))
        return pa.StructArray.from_arrays(
            [runs, pa.array([r["collapsed"] for r in rows], pa.binary()).cast(pa.string())], fields=list(_RESULT))

    return text_batches(docs).select("doc_id", found("text").alias("_r")).select("doc_id", "_r.*")
