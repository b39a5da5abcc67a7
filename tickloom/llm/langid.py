"""Language identification of mixed-language text.

Letters are scored by character trigrams, summed to one score per word and language. The script of a
word narrows its candidate languages to those that were seen to use that script. A Viterbi pass with a
switching penalty then labels every word, and runs of equal labels are the text's language spans.

The Viterbi pass is skipped where it is known to give one span: if no stretch of words prefers another
language to the leading one by more than half the penalty, no switch can pay.

Learning takes text and lang only, from a hash sample of about ``docs_per_language`` rows of each language
(the documented bound); all texts are read whole. Null or empty text, or one without letters, is ``und``
with score 0 and no spans. With nothing to learn from, everything is ``und``. A language's name is never
split or joined; a null lang teaches nothing. Repeated rows give repeated results. A very long text is scored and
decoded in blocks of words; only a bit per word and language is kept of it.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import portions, text_batches

BITS = 15
PENALTY = 24.0
#: A word's evidence against a language is at most this many nats, so one odd word decides nothing.
FLOOR = -8.0
DOCS_PER_LANGUAGE = 1500
#: Characters worked on together, with up to four languages; fewer with more.
PORTION = 1 << 20
#: Word scores (words x languages) held at a time; longer texts are worked on in blocks.
CELLS = 1 << 22
UNKNOWN = "und"

# First and last code point of each script's main blocks; everything else is "other".
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("han", 0x20000, 0x2FA1F),
)
N_SCRIPTS = len({s for s, _, _ in SCRIPTS}) + 1


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: lower-case letter or mark (else 0), whether a letter, script number."""
    n = 0x110000
    code, letter, script = np.zeros(n, np.uint32), np.zeros(n, bool), np.zeros(n, np.uint8)
    for c in range(n):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            code[c] = ord(low) if len(low) == 1 else c
            letter[c] = True
        elif c >= 0x300 and unicodedata.category(ch) in ("Mn", "Mc"):
            code[c] = c
    names = {name: i + 1 for i, name in enumerate(dict.fromkeys(s for s, _, _ in SCRIPTS))}
    for name, first, last in SCRIPTS:
        script[first:last + 1] = names[name]
    return code, letter, script


@dataclass
class Words:
    """The words of a few texts: trigram buckets per letter, and where words and texts begin."""

    buckets: np.ndarray  # per letter
    first: np.ndarray  # per word, its first letter's place among the letters
    place: np.ndarray  # per word, its first character's place in its text
    length: np.ndarray  # per word, in characters
    script: np.ndarray  # per word
    text: np.ndarray  # per word, the text's number
    has_letter: np.ndarray  # per text


def words_of(texts: list[str]) -> Words:
    code, letter, script = _tables()
    cp = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    c = code[cp]
    at = np.flatnonzero(c)
    mid = c[at]
    with np.errstate(over="ignore"):
        mixed = c[at - 1] * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA77) + c[at + 1] * np.uint32(0xC2B2AE3D)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(c[at - 1] == 0)
    start = at[first]
    text = np.searchsorted(begin, start, side="right") - 1
    has = np.zeros(len(texts), bool)
    seen = letter[cp[at]]
    has[np.searchsorted(begin, at[seen], side="right") - 1] = True
    return Words(mixed >> np.uint32(32 - BITS), first, start - begin[text], np.diff(np.append(first, len(at))),
                 script[mid[first]], text, has)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (2 ** BITS, languages) log probabilities
    allowed: np.ndarray  # (scripts, languages) 0, or a large negative number
    penalty: float = PENALTY

    def word_scores(self, w: Words) -> np.ndarray:
        """Per word and language, nats below the word's best language, at most -FLOOR."""
        if not len(w.first):
            return np.zeros((0, len(self.languages)))
        s = np.add.reduceat(self.table[w.buckets], w.first, axis=0).astype(np.float64)
        s += self.allowed[w.script]
        return np.maximum(s - s.max(axis=1, keepdims=True), FLOOR)


def _switch_gain(scores: np.ndarray, lead: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Per word, by how much the best stretch that ends there prefers another language to its text's lead."""
    diff = scores - np.take_along_axis(scores, lead[text][:, None], axis=1)
    total = np.cumsum(diff, axis=0)
    # texts are kept apart by steps larger than any sum, so that the running minimum starts anew in each
    apart = text[:, None] * (np.abs(diff).sum() + 1.0)
    lowest = np.minimum.accumulate(total - diff - apart, axis=0)
    return (total - apart - lowest).max(axis=1)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label sequence of each text (scores: words x languages); texts of like length are stepped together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.empty(0, np.intp)] * len(scores)
    while order:
        longest, k = scores[order[0]].shape
        n = min(max(1, CELLS // max(1, longest * k)), len(order))
        together = [i for i in order[:n] if 2 * len(scores[i]) >= longest]
        order = order[len(together):]
        for i, path in zip(together, _stepped([scores[i] for i in together], penalty)):
            out[i] = path
    return out


def _stepped(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Viterbi over texts in descending length, padded to the first."""
    lens = np.array([len(s) for s in scores])
    steps, n, k = int(lens[0]), len(scores), scores[0].shape[1]
    padded = np.zeros((steps, n, k))
    for row, s in enumerate(scores):
        padded[:lens[row], row] = s
    v, stay, best = np.zeros((n, k)), np.ones((steps, n, k), bool), np.zeros((steps, n), np.int32)
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # texts longer than the step
    for t in range(steps):
        a = active[t]
        if t:
            lead = v[:a].argmax(axis=1)
            jump = v[np.arange(a), lead][:, None] - penalty
            stay[t, :a] = v[:a] >= jump
            best[t, :a] = lead
            v[:a] = np.maximum(v[:a], jump)
        v[:a] += padded[t, :a]
    label = v.argmax(axis=1)
    path = np.zeros((steps, n), np.int32)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        path[t, :a] = label[:a]
        if t:
            label[:a] = np.where(stay[t, rows[:a], label[:a]], label[:a], best[t, :a])
    return [path[:lens[row], row] for row in range(n)]


def _blocks(model: LanguageModel, w: Words, x: int, y: int) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of words x to y, some words at a time."""
    step = max(1, CELLS // max(1, len(model.languages)))
    for p in range(x, y, step):
        q = min(p + step, y)
        low, high = w.first[p], w.first[q] if q < len(w.first) else len(w.buckets)
        yield p, model.word_scores(replace(w, buckets=w.buckets[low:high], first=w.first[p:q] - low, script=w.script[p:q]))


def _label_long(model: LanguageModel, w: Words, x: int, y: int) -> np.ndarray:
    """Labels of words x to y of one long text: the same pass block by block, which keeps one bit per word and
    language and never the scores of the whole text."""
    k = len(model.languages)
    total = np.zeros(k)
    for _, s in _blocks(model, w, x, y):
        total += s.sum(axis=0)
    lead = int(total.argmax())
    run, lowest, gain = np.zeros(k), np.zeros(k), 0.0
    for _, s in _blocks(model, w, x, y):
        sums = run + np.cumsum(s - s[:, [lead]], axis=0)
        before = np.minimum.accumulate(np.vstack([lowest, np.vstack([run, sums[:-1]])]), axis=0)[1:]
        gain = max(gain, float((sums - before).max()))
        run, lowest = sums[-1], before[-1]
    if gain <= model.penalty / 2:
        return np.full(y - x, lead, np.intp)
    stay, best = np.empty((y - x, (k + 7) // 8), np.uint8), np.empty(y - x, np.int32)
    v = np.zeros(k)
    for p, s in _blocks(model, w, x, y):
        kept = np.ones(s.shape, bool)
        for i, row in enumerate(s):
            if p + i > x:
                top = int(v.argmax())
                jump = v[top] - model.penalty
                kept[i] = v >= jump
                best[p + i - x] = top
                v = np.maximum(v, jump)
            v = v + row
        stay[p - x:p - x + len(s)] = np.packbits(kept, axis=1)
    path = np.empty(y - x, np.intp)
    label = int(v.argmax())
    for t in range(y - x - 1, -1, -1):
        path[t] = label
        if t and not stay[t, label >> 3] >> (7 - (label & 7)) & 1:
            label = int(best[t])
    return path


def label_words(model: LanguageModel, w: Words, n_texts: int) -> np.ndarray:
    """A language number per word."""
    bounds = np.searchsorted(w.text, np.arange(n_texts + 1))
    filled = np.flatnonzero(np.diff(bounds))
    if not len(filled):
        return np.zeros(0, np.intp)
    if len(w.first) * len(model.languages) > CELLS:
        return np.concatenate([_label_long(model, w, bounds[i], bounds[i + 1]) for i in filled])
    scores = model.word_scores(w)
    lead = np.zeros(n_texts, np.intp)
    lead[filled] = np.add.reduceat(scores, bounds[filled], axis=0).argmax(axis=1)
    labels = lead[w.text]
    gain = np.zeros(n_texts)
    gain[filled] = np.maximum.reduceat(_switch_gain(scores, lead, w.text), bounds[filled])
    mixed = np.flatnonzero(gain > model.penalty / 2)
    if len(mixed):
        for i, path in zip(mixed, viterbi([scores[bounds[i]:bounds[i + 1]] for i in mixed], model.penalty)):
            labels[bounds[i]:bounds[i + 1]] = path
    return labels


def predict(model: LanguageModel, texts: list[str | None]) -> list[dict]:
    """Per text: lang_pred, score (share of letters in spans of that language), spans."""
    out: list[dict] = []
    names = model.languages
    for a, b in portions([len(t or "") for t in texts], PORTION * 4 // max(4, len(names))):
        part = [t or "" for t in texts[a:b]]
        w = words_of(part)
        labels = label_words(model, w, len(part)) if names else np.zeros(len(w.first), np.intp)
        bounds = np.searchsorted(w.text, np.arange(len(part) + 1))
        for i in range(len(part)):
            x, y = bounds[i], bounds[i + 1]
            if x == y or not w.has_letter[i] or not names:
                out.append({"lang_pred": UNKNOWN, "score": 0.0, "spans": []})
                continue
            own, length, place = labels[x:y], w.length[x:y], w.place[x:y]
            weight = np.bincount(own, weights=length, minlength=len(names))
            cut = np.flatnonzero(np.diff(own)) + 1
            heads, tails = np.append(0, cut), np.append(cut, y - x) - 1
            out.append({
                "lang_pred": names[int(weight.argmax())], "score": float(weight.max() / weight.sum()),
                "spans": [{"start": int(place[p]), "end": int(place[q] + length[q]), "lang": names[own[p]]}
                          for p, q in zip(heads, tails)],
            })
    return out


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """Whether a document is kept from learning; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          docs_per_language: int = DOCS_PER_LANGUAGE, seed: int = 5) -> LanguageModel:
    """Trigram counts of a hash sample of about ``docs_per_language`` rows per language."""
    rows = text_batches(labelled).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0)))
    share = F.create_map(*(F.lit(x) for n in names for x in (n, min(1.0, docs_per_language / sizes[n]))))
    chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(chance < share[F.col("lang")])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a, b in portions([len(t) for t in texts], PORTION):
                w = words_of(texts[a:b])
                number = {n: i for i, n in enumerate(dict.fromkeys(langs[a:b]))}
                of_text = np.array([number[x] for x in langs[a:b]])
                of_letter = np.repeat(of_text[w.text], w.length)
                of_word = np.bincount(of_text[w.text] * N_SCRIPTS + w.script, weights=w.length,
                                      minlength=len(number) * N_SCRIPTS)
                grams = np.bincount((of_letter << BITS) + w.buckets, minlength=len(number) << BITS)
                for name, i in number.items():
                    g, s = grams[i << BITS:(i + 1) << BITS], of_word[i * N_SCRIPTS:(i + 1) * N_SCRIPTS]
                    at, used = np.flatnonzero(g), np.flatnonzero(s)
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([name] * (len(at) + len(used)), pa.string()),
                        "slot": pa.array(np.append(at, used + (1 << BITS)), pa.int32()),
                        "n": pa.array(np.append(g[at], s[used]).astype(np.int64))})

    counts = (sample.select("lang", "text").mapInArrow(counted, "lang string, slot int, n long")
              .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    number = {n: i for i, n in enumerate(names)}
    full = np.zeros(((1 << BITS) + N_SCRIPTS, len(names)))
    full[counts["slot"].to_numpy(), [number[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    grams, scripts = full[:1 << BITS], full[1 << BITS:]
    table = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * (1 << BITS)))
    used = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    used |= ~used.any(axis=1, keepdims=True)  # a script that no language uses narrows nothing
    return LanguageModel(names, table.astype(np.float32), np.where(used, 0.0, -1e6))


_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])
_DDL = "struct<lang_pred:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"


def identified(model: LanguageModel, text: Column | str = "text") -> Column:
    """Struct column (lang_pred, score, spans) of a text column."""

    @F.arrow_udf(_DDL)
    def guess(arr: pa.Array) -> pa.Array:
        return pa.array(predict(model, arr.to_pylist()), type=_RESULT)

    return guess(text)


def language_id(docs: DataFrame, penalty: float = PENALTY, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Learn from the documents that are not held out and label all: doc_id, held_out, lang_pred, score, spans."""
    model = learn(docs.filter(~held_out("doc_id")), docs_per_language=docs_per_language)
    model = LanguageModel(model.languages, model.table, model.allowed, penalty)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"),
                       identified(model).alias("_l")).select("doc_id", "held_out", "_l.*")
