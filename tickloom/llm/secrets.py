"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags every token as Begin, Inside or Outside of a secret. A token's features are its shape (length,
digits, upper case, marks, changes between digits and letters, hexadecimal only), its neighbours (whether a
word like "password" stands within two tokens before it, the characters just before and after it) and its
file (whether the text holds such a word at all, its share of digits). Tags are decoded by Viterbi. A text is
decoded only if some token could gain anything by not being Outside; for all others all-Outside is provably
the best path, and that bound is computed for every token of every text.

The field is trained on windows around the pattern matches of a hash sample of about ``sample_docs`` documents
(the documented bound), of which at most half of ``windows`` hold a secret and half hold none; equal windows count
once. Scanning covers whole texts.

Spans are in code points, end exclusive. A field span that overlaps a pattern span is dropped, so patterns
stay. Null or empty text: no spans. Without any labelled window the field is empty and tags nothing. Repeated
rows give repeated results.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import portions, text_batches, utf8

# The base patterns; the group whose length counts, and its least length.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
KINDS = (*(k for k, *_ in BASE), "field")
# Words that announce a secret, lower case.
ANNOUNCE = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "bearer", "private key")
_COMPILED = tuple((k, re.compile(p, re.ASCII | re.IGNORECASE if k == "assign" else re.ASCII), g, n)
                  for k, p, g, n in BASE)
_MAYBE = r"(?i)passw|secret|token|api_?key|akia|[0-9a-f]{32}|credential|bearer|private key"
_SAID = re.compile("|".join(ANNOUNCE).encode())

SAMPLE_DOCS, WINDOWS, REACH = 20_000, 2_000, 7
#: One in so many texts also gives windows that hold no secret.
THIN = 8
PORTION = 1 << 20

# Byte classes: 0 separator, 1 lower, 2 upper, 3 digit, 4 mark inside tokens, 5 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 1, 2, 3
_CLASS[[ord(c) for c in "+/_.-"]], _CLASS[128:] = 4, 5
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_BESIDE = np.zeros(256, np.uint8)  # what stands next to a token: other, space, quote, = or :
_BESIDE[[9, 10, 13, 32]], _BESIDE[[34, 39, 96]], _BESIDE[[58, 61]] = 1, 2, 3
#: Values of each feature.
FEATURES = {"length": 12, "digits": 5, "upper": 4, "marks": 3, "changes": 5, "hex": 4, "length_changes": 60,
            "before": 4, "after": 4, "announced": 3, "file": 4}
OFFSETS = np.cumsum([0, *FEATURES.values()])
N_FEATURES = int(OFFSETS[-1])
B, I, O = 0, 1, 2
_LENGTHS = np.array([2, 3, 5, 8, 12, 16, 20, 24, 32, 40, 64])


@dataclass
class Tokens:
    start: np.ndarray  # byte place in the joined texts
    end: np.ndarray
    text: np.ndarray  # number of the text
    features: np.ndarray  # (tokens, features) places in the weight vector


def tokens_of(texts: list[bytes], announced: list[bool]) -> tuple[Tokens, np.ndarray]:
    """Tokens with their features, and where each text begins in the joined bytes."""
    joined = b"\n" + b"\n".join(texts) + b"\n"
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    raw = np.frombuffer(joined, np.uint8)
    cls = _CLASS[raw]
    inside = cls > 0
    edge = np.diff(inside.view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if not len(start):
        return Tokens(start, end, start, np.zeros((0, len(FEATURES)), np.int32)), begin
    text = np.searchsorted(begin, start, side="right") - 1

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.cumsum(flag, dtype=np.int32)
        return total[end - 1] - total[start - 1]

    n = end - start
    digits, upper, marks, hexes = count(cls == 3), count(cls == 2), count(cls == 4), count(_HEX[raw])
    change = np.zeros(len(raw), bool)
    change[1:] = ((cls[1:] == 3) != (cls[:-1] == 3)) & inside[1:] & inside[:-1]
    changes = count(change)
    beyond = count(cls == 5) > 0
    share = digits / n
    length = np.digitize(n, _LENGTHS)
    changed = np.digitize(changes, [1, 2, 4, 7])
    shape = [
        length, np.where(digits == 0, 0, np.digitize(share, [0.2, 0.5, 1.0]) + 1),
        np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper < n / 2, 2, 3))), np.minimum(marks, 2), changed,
        np.where(beyond, 3, np.where(hexes == n, np.where(digits > 0, 2, 1), 0)), length * 5 + changed,
        _BESIDE[raw[start - 1]], _BESIDE[raw[end]],
    ]
    said = np.zeros(len(start), np.int8)
    for i in np.flatnonzero(announced):
        low, high = int(begin[i]), int(begin[i]) + len(texts[i])
        for m in _SAID.finditer(texts[i].lower()):
            k = int(np.searchsorted(start, low + m.end()))  # first token after the word
            for step, value in ((0, 2), (1, 1)):
                if k + step < len(start) and start[k + step] < high and start[k + step] - (low + m.end()) < 40:
                    said[k + step] = max(said[k + step], value)
    per_text = np.bincount(text, weights=digits, minlength=len(texts)) / np.maximum(np.diff(begin)[:len(texts)], 1)
    file = (per_text > 0.02).astype(np.int8) + 2 * np.array(announced, np.int8)
    features = np.stack([*shape, said, file[text]], axis=1).astype(np.int32)
    return Tokens(start, end, text, features + OFFSETS[:-1].astype(np.int32)), begin


@dataclass(frozen=True)
class Field:
    """Emission weights (features x tags), transition weights (tags x tags), start weights (tags)."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    @staticmethod
    def empty() -> Field:
        return Field(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.array([-1.0, -1.0, 0.0]))

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for j in range(features.shape[1]):
            out += self.emit[features[:, j]]
        return out

    def could_gain(self, scores: np.ndarray) -> np.ndarray:
        """Whether a token could be part of a stretch that beats all-Outside. A stretch's gain over Outside is at
        most the sum of its tokens' best gains, each with the dearest transition; only a positive one can help."""
        move = self.move - self.move[O, O]
        move[I, :] = np.where(np.isfinite(move[I, :]), move[I, :], -np.inf)
        into = max(move[:, [B, I]].max(), (self.first[[B, I]] - self.first[O]).max())
        back = max(0.0, move[[B, I], O].max())
        return (scores[:, [B, I]].max(axis=1) - scores[:, O]) + into + back > 0

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tag sequence of one text."""
        move = self.move.tolist()
        rows = scores.tolist()
        v = [self.first[k] + rows[0][k] for k in range(3)]
        back: list[tuple[int, int, int]] = []
        for row in rows[1:]:
            came, new = [], []
            for k in range(3):
                a, b, c = v[0] + move[0][k], v[1] + move[1][k], v[2] + move[2][k]
                j = 2 if c >= a and c >= b else (0 if a >= b else 1)
                came.append(j)
                new.append((a, b, c)[j] + row[k])
            back.append(tuple(came))
            v = new
        tag = max((O, B, I), key=lambda k: v[k])
        tags = [tag]
        for came in reversed(back):
            tag = came[tag]
            tags.append(tag)
        return np.array(tags[::-1])


def train(windows: np.ndarray, tags: np.ndarray, rounds: int = 80, rate: float = 0.2, ridge: float = 2e-3) -> Field:
    """Penalised maximum likelihood by adaptive gradient steps. ``windows``: (n, length, features) weight places,
    -1 beyond a text's end; ``tags``: (n, length)."""
    n, steps, _ = windows.shape
    if not n or not (tags == B).any():
        return Field.empty()
    real = windows[:, :, 0] >= 0
    place = np.where(windows >= 0, windows, N_FEATURES)
    banned = np.zeros((3, 3))
    banned[O, I] = -1e4  # Inside follows Begin or Inside
    emit, move, first = np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    start_ban = np.array([0.0, -1e4, 0.0])
    hot = np.eye(3)[tags] * real[:, :, None]
    pair_seen = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    m1, m2 = [np.zeros_like(x) for x in (emit, move)], [np.zeros_like(x) for x in (emit, move)]

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        e = emit[place].sum(axis=2) * real[:, :, None]
        moves = move + banned
        alpha, beta = np.zeros((steps, n, 3)), np.zeros((steps, n, 3))
        alpha[0] = first + start_ban + e[:, 0]
        for t in range(1, steps):
            go = logsum(alpha[t - 1][:, :, None] + moves, 1) + e[:, t]
            alpha[t] = np.where(real[:, t, None], go, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            go = logsum((beta[t + 1] + e[:, t + 1])[:, None, :] + moves, 2)
            beta[t] = np.where(real[:, t + 1, None], go, beta[t + 1])
        total = logsum(alpha[-1], 1)
        single = np.exp(alpha + beta - total[None, :, None]).transpose(1, 0, 2) * real[:, :, None]
        pair = np.zeros((3, 3))
        for t in range(1, steps):
            joint = alpha[t - 1][:, :, None] + moves + (e[:, t] + beta[t])[:, None, :] - total[:, None, None]
            pair += (np.exp(np.minimum(joint, 0)) * real[:, t, None, None]).sum(axis=0)
        grad = np.zeros_like(emit)
        for j in range(place.shape[2]):
            for k in range(3):
                grad[:, k] += np.bincount(place[:, :, j].ravel(), weights=(hot - single)[:, :, k].ravel(),
                                          minlength=N_FEATURES + 1)
        for i, (w, g) in enumerate(((emit, grad / n - ridge * emit), (move, (pair_seen - pair) / n - ridge * move))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            w += rate * (m1[i] / (1 - 0.9 ** step)) / (np.sqrt(m2[i] / (1 - 0.99 ** step)) + 1e-6)
        emit[N_FEATURES] = 0
    return Field(emit[:N_FEATURES], move + banned, first + start_ban)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret value) of the pattern matches in one text."""
    found = []
    for k, (_, pattern, group, least) in enumerate(_COMPILED):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), k, m.end(), m.start(group)))
    return sorted(found)


def _code_points(text: bytes) -> np.ndarray:
    """The byte at which each code point starts."""
    return np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)


def scan(texts: pa.Array, field: Field | None) -> list[list[tuple[int, int, int, int]]]:
    """Per text the sorted (start, kind number, end, value start) of all spans."""
    raw = [t or b"" for t in utf8(texts)]
    maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False).to_pylist()
    out = [base_spans(t.decode()) if hit else [] for t, hit in zip(raw, maybe)]
    if field is None:
        return out
    for a, b in portions([len(t) for t in raw], PORTION):
        tok, begin = tokens_of(raw[a:b], maybe[a:b])
        if not len(tok.start):
            continue
        scores = field.scores(tok.features)
        bounds = np.searchsorted(tok.text, np.arange(b - a + 1))
        for i in np.unique(tok.text[field.could_gain(scores)]).tolist():
            x, y = bounds[i], bounds[i + 1]
            tags = field.decode(scores[x:y])
            heads = np.flatnonzero(tags == B)
            if not len(heads):
                continue
            base, starts = out[a + i], _code_points(raw[a + i])
            reach = np.maximum.accumulate([q for _, _, q, _ in base] or [0])
            spans = []
            for h in heads.tolist():
                last = h
                while last + 1 < y - x and tags[last + 1] == I:
                    last += 1
                s, e = (int(np.searchsorted(starts, p - begin[i])) for p in (tok.start[x + h], tok.end[x + last]))
                behind = bisect.bisect_left(base, (e,))  # pattern spans that start before the span's end
                if not behind or reach[behind - 1] <= s:
                    spans.append((s, len(KINDS) - 1, e, s))
            out[a + i] = sorted(base + spans)
    return out


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = WINDOWS, reach: int = REACH,
          seed: int = 11) -> Field:
    """Train on windows of 2 * reach + 1 tokens of the sample: at most ``windows`` / 2 different ones around pattern
    matches and as many others, so that neither many secrets nor many copies crowd out the rest."""
    rows = text_batches(docs).select("text").filter("text is not null")
    n = rows.count()
    chance = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(chance < min(1.0, sample_docs / max(n, 1)))
    width = 2 * reach + 1

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            raw, spans = utf8(column), scan(column, None)
            maybe = pc.match_substring_regex(column, _MAYBE).to_pylist()
            for i, (t, found) in enumerate(zip(raw, spans)):
                tok, _ = tokens_of([t], [maybe[i]])
                if not len(tok.start):
                    continue
                tags = np.full(len(tok.start), O, np.int8)
                at = np.append(_code_points(t), len(t)) + 1
                for _, _, end, value in found:
                    first = np.searchsorted(tok.end, at[value], side="right")
                    after = np.searchsorted(tok.start, at[end])
                    tags[first:after] = I
                    tags[first:min(first + 1, after)] = B
                spot = int(hashlib.md5(t).hexdigest()[:8], 16)
                centres = np.flatnonzero(tags == B).tolist()
                if spot % THIN == 0:
                    centres.append(spot % len(tags))
                digit = np.flatnonzero((tok.features[:, 1] > OFFSETS[1]) & (tags == O))
                if len(digit) and spot // THIN % THIN == 0:  # tokens with digits are the harder ones
                    centres.append(int(digit[spot % len(digit)]))
                if not centres:
                    continue
                padded = np.pad(tok.features, ((reach, reach), (0, 0)), constant_values=-1)
                tags = np.pad(tags, reach, constant_values=O)
                own = list(dict.fromkeys(centres))
                yield pa.RecordBatch.from_pydict({
                    "positive": pa.array([bool(tags[c + reach] == B) for c in own]),
                    "mixed": pa.array([(spot * 31 + c * 2654435761) % (1 << 32) for c in own], pa.int64()),
                    "features": pa.array([padded[c:c + width].astype("<i2").tobytes() for c in own], pa.binary()),
                    "tags": pa.array([tags[c:c + width].tobytes() for c in own], pa.binary())})

    found = sample.mapInArrow(labelled, "positive boolean, mixed long, features binary, tags binary")
    once = found.groupBy("positive", "features", "tags").agg(F.min("mixed").alias("mixed"))
    kinds = [once.filter(F.col("positive") == kind).orderBy("mixed", "features").limit(windows // 2) for kind in (True, False)]
    both = kinds[0].unionByName(kinds[1]).toArrow()
    if not both.num_rows:
        return Field.empty()
    features = np.stack([np.frombuffer(x, "<i2").reshape(width, -1) for x in both["features"].to_pylist()])
    return train(features, np.stack([np.frombuffer(x, np.int8) for x in both["tags"].to_pylist()]).astype(np.intp))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))


def found_spans(field: Field, text: Column | str = "text") -> Column:
    """Array of (kind, start, end, value) of a text column; ``value`` is where the secret itself starts."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,value:bigint>>")
    def spans(arr: pa.Array) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e, "value": v} for s, k, e, v in row]
                         for row in scan(arr, field)], type=_SPANS)

    return spans(text)


def secret_scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_field, base_sha256 and spans
    (kind:start:end by start, then kind as listed in ``KINDS``, comma-joined)."""
    rows = text_batches(docs).select("doc_id", found_spans(field or learn(docs)).alias("found"))
    listed = F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    base = F.filter(listed, lambda x: ~x.startswith(KINDS[-1]))
    kinds = F.transform("found", lambda x: x["kind"])
    n = [(F.size("found") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *n, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
                       F.array_join(listed, ",").alias("spans"))


def redacted(docs: DataFrame, field: Field | None = None, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret value replaced by ``mark`` and n_chars (if there) set anew; all rows stay."""
    field = field or learn(docs)

    @F.arrow_udf("string")
    def clean(arr: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(arr.to_pylist(), scan(arr, field)):
            if spans:
                parts, at = [], 0
                for _, _, end, value in sorted(spans, key=lambda s: s[3]):
                    if value >= at:
                        parts += [text[at:value], mark]
                    at = max(at, end)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    cleaned = text_batches(docs).withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        n = F.when(docs["n_chars"].isNotNull(), F.char_length(F.col("text")).cast(docs.schema["n_chars"].dataType))
        cleaned = cleaned.withColumn("n_chars", n)
    return cleaned
