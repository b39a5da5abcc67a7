"""Near-duplicates, nearest neighbours, packing and the pipeline against plain versions."""

from __future__ import annotations

import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import fixtures  # noqa: E402

import corpus_pipeline  # noqa: E402
from tickloom.llm import forest, packing, paragraphs, simhash, tiles  # noqa: E402
from tickloom.llm.components import components  # noqa: E402
from tickloom.llm.queries import VOCABULARY  # noqa: E402

SF = "/root/testdata/sf0.001"


def groups_of(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


# --- components -----------------------------------------------------------------------------------------------

def test_components_of_chains_stars_and_random_edges(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(900, i) for i in range(860, 899)]
    edges += [(draw.randint(1000, 1200), draw.randint(1000, 1200)) for _ in range(150)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = groups_of({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


# --- SimHash --------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(rows):
    f = [plain_fingerprint(t) for _, t, *_ in rows]
    ids = list(range(len(rows)))
    pairs = [(i, j) for i in ids for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2]
    return f, groups_of(ids, pairs)


def test_simhash_against_all_pairs(spark):
    rows = fixtures.documents()
    f, group = linked(rows)
    least = defaultdict(list)
    for i, g in group.items():
        least[g].append(rows[i][0])
    want = [(rows[i][0], format(f[i], "016x"), min((d for d in least[group[i]] if d is not None), default=None)) for i in group]
    got = simhash.simhash_components(fixtures.table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert simhash.simhash_components(fixtures.table(spark, [])).collect() == []


def test_linked_fingerprints_lose_no_pair(spark):
    draw = random.Random(8)
    fps = {draw.getrandbits(64) for _ in range(150)} | {0, 1, 3, (1 << 64) - 1, 1 << 63}
    for x in list(fps)[:60]:
        fps |= {x ^ 1 << draw.randrange(64), x ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64)}
        fps.add(x ^ sum(1 << b for b in draw.sample(range(64), 3)))
    signed = sorted(simhash._signed(x) for x in fps)
    want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert {(r.a, r.b) for r in got} == want and len(want) > 100


def test_one_document_of_each_group_stays(spark):
    rows = fixtures.documents()
    docs = fixtures.table(spark, rows)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    _, group = linked(rows)
    best = {}
    for i, g in group.items():
        rank = (rows[i][0] is None, rows[i][0] or 0)
        best[g] = min(best.get(g, (True, 1 << 60)), rank)
    assert Counter(r.doc_id for r in got) == Counter(None if null else d for null, d in best.values())
    assert set(map(tuple, got)) <= set(rows)


# --- paragraphs -----------------------------------------------------------------------------------------------

def plain_paragraphs(text):
    """(line number, is a block, words) of every line with words and every block of wrapped lines."""
    block = []
    for n, line in enumerate([*(text or "").split("\n"), ""]):
        if words(line):
            yield n, False, words(line)
            block.append((n, line))
        else:
            if len(block) > 1 and all(len(x.encode()) <= paragraphs.WRAPPED for _, x in block[:-1]):
                yield block[0][0], True, words(" ".join(x for _, x in block))
            block = []


def plain_removals(rows, similarity=0.8):
    places = defaultdict(set)
    for d, t, *_ in rows:
        for n, is_block, w in plain_paragraphs(t):
            places[" ".join(w)].add((d is None, d or 0, n, is_block))
    keys = sorted(places)
    sets = [{tuple(k.split()[i:i + 5]) for i in range(max(1, len(k.split()) - 4))} for k in keys]
    pairs = [(i, j) for i in range(len(keys)) for j in range(i)
             if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    group = groups_of(range(len(keys)), pairs)
    out = defaultdict(list)
    for i, g in group.items():
        out[g] += places[keys[i]]
    return {p: min(v) for v in out.values() for p in v if p != min(v)}


def wrapped(draw, w, width):
    """Words in lines of at most ``width`` characters."""
    lines, line = [], ""
    for x in w:
        if line and len(line) + 1 + len(x) > width:
            lines.append(line)
            line = ""
        line = f"{line} {x}".strip()
    return "\n".join([*lines, line])


def wrapped_documents():
    """Paragraphs wrapped at different widths, word for word and with one word changed, between others; repeats inside a text."""
    draw = random.Random(9)
    shared = [fixtures.sentence(draw, "aa", 70).split() for _ in range(3)]
    rows = []
    for i in range(24):
        w = list(draw.choice(shared))
        if i % 3 == 0:
            w[draw.randrange(len(w))] = f"changed{i}"
        parts = [wrapped(draw, x, draw.choice([50, 72, 80])) for x in (fixtures.sentence(draw, "bb", 40).split(), w, fixtures.sentence(draw, "cc", 30).split())]
        if i % 4 == 1:
            parts.append("all rights reserved")
        rows.append((300 + i, "\n\n".join(parts + parts[:1] * (i % 5 == 2)), "aa", "s", 1, *fixtures.EXTRA))
    return rows


@pytest.mark.parametrize("block", [2, 256])
def test_paragraph_removals_against_all_pairs(spark, block):
    rows = fixtures.documents() + wrapped_documents()
    got = paragraphs.removals(fixtures.table(spark, rows), block=block).filter("paragraph is not null").collect()
    texts = {d: t for d, t, *_ in rows if d is not None}
    want = plain_removals(rows)
    assert any(not r.exact for r in got) and any(kind for *_, kind in want) and any(d == 321 for _, d, *_ in want)
    found = Counter()
    for r in got:
        kind = False
        if r.doc_id is not None:
            own, lines = texts[r.doc_id][r.start:r.end], texts[r.doc_id].split("\n")
            kind = "\n" in own
            assert own.startswith(lines[r.paragraph]) and (kind or own == lines[r.paragraph])
        found[(r.doc_id is None, r.doc_id or 0, r.paragraph, kind), (r.kept_doc_id is None, r.kept_doc_id or 0, r.kept_paragraph)] += 1
    # a line and a block of two null rows may share a name
    assert set(found) == {(p, kept[:3]) for p, kept in want.items()}


def test_paragraphs_of_the_shared_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {(False, r.doc_id, r.paragraph, "\n" in texts[r.doc_id][r.start:r.end])
           for r in paragraphs.removals(docs).filter("paragraph is not null").collect()}
    want = plain_removals([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got == set(want)


def windows(text, n):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1) if len(set(w[i:i + n])) > 1}


def spans_of(text):
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def repeats(rows, size):
    """Per row the words of all stretches of ``size`` words that stand at an earlier place too, not overlapping it."""
    first, out = {}, defaultdict(set)
    for k, (d, t) in enumerate(rows):
        w = words(t or "")
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            if len(set(key)) == 1:
                continue
            if key in first and (first[key][0] != k or i >= first[key][1] + size):
                out[k] |= set(range(i, i + size))
            first.setdefault(key, (k, i))
    return out


def test_every_word_of_a_shared_window_is_covered_and_little_else(spark):
    draw = random.Random(12)
    passages = [fixtures.sentence(draw, "aa", n) for n in (50, 51, 60, 100, 200)]
    rows = []
    for i in range(80):
        parts = [fixtures.sentence(draw, draw.choice("ab") * 2, draw.randint(1, 300)) for _ in range(2)]
        if i % 2:
            parts.insert(1, draw.choice(passages).upper() if i % 5 == 0 else draw.choice(passages))
        if i % 16 == 3:  # a part of a passage, and the same passage twice in one text
            cut = passages[4].split()
            parts += [" ".join(cut[draw.randint(0, 60):draw.randint(130, 200)]), passages[1], "between", passages[1]]
        rows.append((i, draw.choice([" ", "  \t", "\n"]).join(parts)))
    rows += [(100, "the " * 300), (101, "the " * 300), (102, None), (103, ""), (104, "a b c d e f g " * 40), (None, passages[3] + " end")]
    got = defaultdict(set)
    for r in paragraphs.repeated_segments(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        k = next(i for i, (d, _) in enumerate(rows) if d == r.doc_id)
        inside = {i for i, (a, b) in enumerate(spans_of(rows[k][1])) if r.start <= a and b <= r.end}
        assert len(inside) == r.n_words >= 25 and not got[k] & inside
        got[k] |= inside
    whole, part = repeats(rows, 50), repeats(rows, 25)
    for k in range(len(rows)):
        # a word or two may agree beyond a passage by chance
        assert len(got[k] - part[k] - whole[k]) <= 4, (k, sorted(got[k] - part[k]))
    # where a segment's first place holds a part of the passage only, the rest is compared with that part
    missed = {k: sorted(whole[k] - got[k]) for k in range(len(rows)) if whole[k] - got[k]}
    assert sum(map(len, missed.values())) <= 0.01 * sum(map(len, whole.values())) > 20, missed


def test_rows_without_an_id_or_with_a_shared_one(spark):
    draw = random.Random(3)
    passage = fixtures.sentence(draw, "aa", 60)
    one, two, three = (fixtures.sentence(draw, "bb", 40) for _ in range(3))  # the lines are no near copies
    rows = [(None, f"{one} {passage} x"), (None, f"{two} {passage} y"), (None, "clean text of its own " * 2), (7, f"{three} {passage}"),
            (7, "seven and nothing else"), (7, f"{three} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = Counter(r.text for r in paragraphs.cleaned(docs, paragraphs.removals(docs)).collect())
    # the first row by id keeps the passage, repeats in full stay alike, clean rows without an id stay whole
    assert texts == Counter({f"{three} {passage}": 2, f"{one}  x": 1, f"{two}  y": 1, "clean text of its own " * 2: 1, "seven and nothing else": 1})


def test_cleaned_texts_lose_their_repeats_only(spark):
    docs = fixtures.table(spark)
    found = paragraphs.removals(docs)
    out = paragraphs.cleaned(docs, found)
    assert out.columns == docs.columns and out.count() == docs.count()
    again = paragraphs.removals(out.filter("doc_id is not null")).collect()
    assert all(r.n_words < 50 for r in again) and len(again) < len(found.collect()) / 10  # cuts join what stood apart
    gone = {r.doc_id for r in found.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == before[r.doc_id] for r in out.collect() if r.doc_id is not None and r.doc_id not in gone)
    assert paragraphs.removals(fixtures.table(spark, [])).collect() == []


# --- packing --------------------------------------------------------------------------------------------------

def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_tokenizers_file():
    draw = random.Random(6)
    texts = [t or "" for _, t, *_ in fixtures.documents() if t is None or len(t) < 60_000]
    texts += ["".join(draw.choices("ab 1\n\t.'sſé漢 　\U0001f600!-", k=draw.randint(0, 60))) for _ in range(800)]
    texts += ["<|endoftext|> x", "don't I'LL we've", "  a  b  ", "\r\n\r\n x"]
    enc = packing._encoding(VOCABULARY, public_tokenizers.PATTERN)
    assert [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)] == [enc.encode_ordinary(t) for t in texts]


def packed(spark, rows, **options):
    return packing.pack(fixtures.table(spark, rows).repartition(3), VOCABULARY, public_tokenizers.PATTERN, **options).collect()


@pytest.mark.parametrize("length", [64, 2048])
def test_pieces_hold_every_token_once(spark, length):
    rows = [r for r in fixtures.documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = packed(spark, rows, length=length)
    t = tokenizer()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for d, text, *_ in rows:
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[d], key=lambda r: r.start)
        ids = [np.frombuffer(r.ids, "<u2").tolist() for r in own]
        assert sum(ids, []) == want and {r.doc_tokens for r in own} == {len(want)}
        assert [r.start for r in own] == [sum(map(len, ids[:i])) for i in range(len(ids))]
        assert all(r.length == len(x) and r.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes()) for r, x in zip(own, ids))
    assert sorted(sequences) == list(range(len(sequences)))
    fill = []
    for s in sorted(sequences):
        at = 0
        for r in sorted(sequences[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fill.append(at)
    full = sum(fill) // length
    assert all(n == length for n in fill[:full]) and all(n & (n - 1) == 0 and n < length for n in fill[full:])
    # every full window holds each source in its proportion, to the rounding of a window's two rounds and
    # to what a round (total / rounds tokens) is short of a window
    short = length - sum(fill) / -(-sum(fill) // length)
    total = Counter()
    for r in got:
        total[r.source] += r.length
    for s in range(full):
        own = Counter()
        for r in sequences[s]:
            own[r.source] += r.length
        large = {k: n for k, n in total.items() if n >= sum(fill) / 256}
        assert all(abs(own[k] - length * n / sum(fill)) <= 3 + short for k, n in large.items())


def test_packing_of_nulls_repeats_and_nothing(spark):
    rows = fixtures.documents()
    got = packed(spark, rows, with_ids=False)
    t = tokenizer()
    want = sum(len(e.ids) + 1 for e in t.encode_batch([x[1] or "" for x in rows], add_special_tokens=False))
    assert sum(r.length for r in got) == want and "ids" not in got[0]
    assert packed(spark, []) == []


def test_served_counts_do_not_overflow():
    rounds = np.array([0, 1, 19_999_999_999, 20_000_000_000])
    size = 40_000_000_000_123
    assert packing.served(rounds, size, 20_000_000_000).tolist() == [int(r) * size // 20_000_000_000 for r in rounds]


# --- vectors --------------------------------------------------------------------------------------------------

def vector_rows(seed=2, n=300, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:120] = x[0] + rng.normal(size=(70, dim)) * 0.12  # a group of near copies
    x[130:150] = x[3]  # exact copies
    x[160] = x[4] * 3  # the same direction
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(400, None, 0), (401, [0.0] * dim, 0), (402, [1.0] * (dim - 1) + [None], 0), (403, [1.0] * (dim - 1) + [float("nan")], 0),
             (404, [1.0] * (dim - 1) + [float("inf")], 0), (405, [], 0), (406, [1.0, 2.0], 0), (407, [1.0, 2.1], 0), (408, [5.0], 0),
             (500, x[7].tolist(), 0), (500, x[9].tolist(), 0), (3, x[3].tolist(), 0)]
    return rows


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long")


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [40, 8192])
def test_cosine_links_against_all_pairs(spark, block):
    rows = vector_rows()
    ok = [i for i, (_, v, _) in enumerate(rows) if good(v)]
    unit = {i: np.array(rows[i][1], np.float64) for i in ok}
    pairs = [(i, j) for i in ok for j in ok if j < i and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] / (np.linalg.norm(unit[i]) * np.linalg.norm(unit[j])) >= 0.9]
    degree = Counter(x for p in pairs for x in p)
    group = groups_of(range(len(rows)), pairs)
    least = defaultdict(lambda: 1 << 60)
    for i, g in group.items():
        least[g] = min(least[g], rows[i][0])
    want = [(rows[i][0], degree[i], least[group[i]], rows[i][0] == least[group[i]]) for i in range(len(rows))]
    got = tiles.cosine_links(vector_table(spark, rows), block=block).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert tiles.cosine_links(vector_table(spark, [])).collect() == []
    alone = tiles.cosine_links(vector_table(spark, [(None, [1.0, 2.0], 0), (4, None, 0)])).collect()
    assert Counter(map(tuple, alone)) == Counter([(None, 0, None, False), (4, 0, 4, True)])


def test_quantised_bound_holds():
    rng = np.random.default_rng(0)
    for scale in (1.0, 1e-20, 1e20):
        x = rng.normal(size=(200, 64)) * scale
        x[:20] = 0
        x[:20, 0] = scale
        q, s, length, error = tiles.quantised(x)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        bound = (q @ q.T) * s[:, None] * s[None, :] + length[:, None] * error[None, :] + error[:, None]
        assert (unit @ unit.T <= bound + 1e-6).all() and error.max() < 0.05


def test_forest_recall_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = defaultdict(list)
    for r in forest.nearest(docs, F.col("vec_id") % 100 == 0, block=1500, candidates=950).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in docs.collect()}
    hit = 0
    for q, found in got.items():
        score = {v: float(np.sqrt(((x - rows[q]) ** 2).sum())) for v, x in rows.items() if v != q}
        best = sorted(score, key=lambda v: (score[v], v))[:10]
        hit += len(set(best) & {r.vec_id for r in found})
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
    assert set(got) == {v for v in rows if v % 100 == 0} and hit >= 0.9 * 10 * len(got)


def test_forest_takes_all_candidates_and_handles_awkward_rows(spark):
    rows = vector_rows() + [(None, [1.0] * 12, 0)]
    got = defaultdict(list)
    for r in forest.nearest(vector_table(spark, rows), F.col("vec_id") % 100 == 0, candidates=10_000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(r.score, 9), r.vec_id))
    rank = {}  # a query is an id and a vector
    for q, v, _ in rows:
        if q is not None and q % 100 == 0 and good(v):
            rank[q, tuple(v)] = sorted((round(float(np.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum())), 9), d)
                                       for d, x, _ in rows if d is not None and good(x) and len(x) == len(v) and d != q)[:10]
    want = defaultdict(list)
    for (q, _), near in rank.items():
        want[q] += near
    assert set(got) == set(want) and all(sorted(got[q]) == sorted(want[q]) for q in want)
    assert forest.nearest(vector_table(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    few = forest.nearest(vector_table(spark, [(100, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)]), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(100, 1, 1)]


# --- pipeline -------------------------------------------------------------------------------------------------

def test_pipeline_stages_keep_columns_and_whole_results(spark):
    rows = fixtures.documents(n=120)
    docs = fixtures.table(spark, rows)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), fixtures.SCHEMA)
        assert docs.columns == before.columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter({r.doc_id for r in out}) == Counter({r.doc_id for r in docs.collect()})


def test_pipeline_of_an_empty_table(spark):
    docs = fixtures.table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_pipeline_runs_over_the_shared_table(spark):
    out = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.select("doc_id").distinct().count() < n


def test_repeated_query_rows_keep_all_their_neighbours(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(60, 8)).astype(np.float32).astype(float)
    rows = [(i + 1, x[i].tolist()) for i in range(58)] + [(100, x[58].tolist())] * 2 + [(200, x[58].tolist()), (200, x[59].tolist())]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in forest.nearest(docs, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 9)))

    def plain(own, q):
        d = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in rows if i != own)
        return [(k + 1, i, round(s, 9)) for k, (s, i) in enumerate(d[:10])]

    assert sorted(got[100]) == sorted(plain(100, x[58]))
    assert sorted(got[200]) == sorted(plain(200, x[58]) + plain(200, x[59]))


def test_blocks_of_the_forest_are_neither_broadcast_nor_shuffled(spark):
    """As many queries as lie under the limit of a broadcast, whose copies for every block would not."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    x = np.random.default_rng(7).standard_normal((400, 16)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = forest.nearest(docs, F.col("vec_id") % 4 == 0, block=20, candidates=10_000)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
    got = defaultdict(list)
    for r in found.collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    for q in range(0, 400, 4):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [(n + 1, v, d[v]) for n, v in enumerate(v for v in np.lexsort((np.arange(400), d)) if v != q)][:10]
        assert sorted(got[q]) == want
    assert len(got) == 100


def test_nearest_candidates_are_told_from_each_other_exactly():
    draw = np.random.default_rng(11)
    for scale in (1.0, 1e-170, 1e170):
        # near rows that a product of large numbers would mix up, equal ones, and squares beyond any double
        x = (1e6 + draw.integers(0, 3, (300, 5)) * 1e-3) * scale
        x[250:] = x[:50]
        ids, q = draw.permutation(300).astype(np.int64), x[:7]
        with np.errstate(over="ignore"):
            of, found, score = forest.search(forest.Forest(x), x, ids, q, ids[:7], 10, 10_000_000)
            for i in range(7):
                d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                want = sorted((s, v) for s, v in zip(d, ids) if v != ids[i])[:10]
                assert list(zip(score[of == i], found[of == i])) == want
