"""Token counts, periodic runs and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import fixtures  # noqa: E402

from tickloom.llm import centroids, periodic, queries, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


# --- tokens ---------------------------------------------------------------------------------------------------

AWKWARD = [
    "It's THE we'll i'd 'sx x's're", "Straße İstanbul ΣΑΣ ΟΔΟΣ ǆ ﬁ K Å é e ́a", "a\x1cb\x85c\xa0d e　f\x0bg\x0ch",
    "a <|endoftext|> b<|startoftext|><|endoftext|>c <|ENDOFTEXT|> <|end oftext|>", "漢字かな交じり文 한국어 ไทย עברית العربية", "😀👩‍👩‍👧 ½ ² ٣ ௧",
    "x" * 5000 + " " + "0" * 3000, "​﻿­", "\n\n \t", "\U000e0001 힣ᆨ", "don't" * 50, "ﷺ ẞ ŉ ΐ",
]


def library_counts(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_token_counts_of_awkward_texts():
    count = tokens.counter(PATH, tokens.whole_tokens(PATH))
    assert [count(t.encode())[0] for t in AWKWARD] == library_counts(AWKWARD)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_token_counts_of_any_text(text):
    count = test_token_counts_of_any_text.count
    assert count(text.encode())[0] == library_counts([text])[0]


test_token_counts_of_any_text.count = tokens.counter(PATH, tokens.whole_tokens(PATH))


def test_whole_tokens_are_one_token():
    whole = sorted(tokens.whole_tokens(PATH))
    assert len(whole) > 20_000
    alphabet = tokens.byte_alphabet()
    texts = [bytes(alphabet[c] for c in w).decode() for w in whole[::7]]
    assert set(library_counts(texts)) == {1}


def test_memory_of_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    count = tokens.counter(PATH, tokens.whole_tokens(PATH))
    texts = [t for _, t, *_ in fixtures.documents()][:20]
    assert [count(t.encode())[0] for t in texts] == library_counts(texts)


def test_token_counts_on_spark(spark):
    rows = fixtures.documents()
    got = tokens.token_counts(fixtures.table(spark, rows), PATH, limit=100).collect()
    want = [(d, len((t or "").encode()), n, n > 100) for (d, t, *_), n in zip(rows, library_counts([r[1] for r in rows]))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in got)
    assert all(0 <= r.n_direct <= r.n_tokens for r in got) and sum(r.n_direct for r in got) > 0
    assert tokens.token_counts(fixtures.table(spark, rows[:0]), PATH).count() == 0


# --- periodic runs --------------------------------------------------------------------------------------------

def plain_runs(w, fold=4, least=6):
    n, out = len(w), []
    for q in range(1, n // fold + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, fold * q):
                x = w[i:j + q]
                if all(x[d:] != x[:-d] for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(draw: random.Random, n: int) -> list[str]:
    letters = "abcde"[:draw.choice([1, 2, 2, 3, 5])]
    w = [draw.choice(letters) for _ in range(n)]
    for _ in range(draw.randint(0, 3)):
        if n > 4:
            a = draw.randrange(n)
            e, p = draw.randint(a, n), draw.randint(1, max(1, (n - a) // 3))
            w = [w[a + (i - a) % p] if a <= i < e else w[i] for i in range(n)]
    return w


def check_runs(texts):
    for w, got in zip(texts, periodic.scan([" ".join(w).encode() for w in texts])):
        runs = plain_runs(w)
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == runs
        assert got["collapsed"].decode() == plain_collapsed(w, runs)


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_every_period(seed):
    draw = random.Random(seed)
    for _ in range(60):
        check_runs([periodic_text(draw, draw.randint(0, 110)) for _ in range(draw.randint(1, 7))])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=70), st.integers(1, 6), st.integers(0, 30))
def test_runs_of_two_words(w, times, cut):
    check_runs([w * times, (w[:cut] * 4 + w), ["x", *w]])


def test_runs_of_fibonacci_and_thue_morse_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    tm = [str(bin(i).count("1") % 2) for i in range(256)]
    check_runs([b, tm, b * 3, tm * 5, ["z"] * 300, ["z"] * 5 + ["y"] + ["z"] * 6])


def test_runs_reach_neither_over_texts_nor_portions(monkeypatch):
    monkeypatch.setattr(periodic, "PORTION", 10)
    check_runs([["a", "b"] * 2] * 6 + [["a"] * 7] * 3)


def test_a_very_long_text():
    w = [str(i) for i in range(300_000)]
    w[1000:250_000] = (w[1000:1000 + 40_000] * 7)[:249_000]
    w += ["end"] * 9
    got = periodic.scan([" ".join(w).encode()])[0]["runs"]
    assert got == [{"start": 1000, "length": 249_000, "period": 40_000}, {"start": 300_000, "length": 9, "period": 1}]


def planted(d, text):
    w = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    if d is None:
        return w
    h = zlib.crc32(str(d).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_periodic_query_against_every_period(spark, tmp_path):
    # short enough that every period can be tried
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 4000 else r[1][:4000], *r[2:]) for r in fixtures.documents()]
    rows += [(1000 + i, " ".join(f"w{j}" for j in range(i + 1)), "aa", "s", 1, *fixtures.EXTRA) for i in range(150)]
    fixtures.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic(spark, str(tmp_path)).collect()
    want, changed = [], 0
    for d, t, *_ in rows:
        w = planted(d, t)
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        changed += bool(runs)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((d, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want)) and changed > 5


def test_periodic_runs_of_an_empty_table(spark):
    assert periodic.periodic_runs(fixtures.table(spark, fixtures.documents()[:0])).collect() == []


# --- centroids ------------------------------------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int, distance double"


def plain_clusters(rows, k, dim, scale, rounds, seed):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e, *_ in rows
            if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    draw = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in draw[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        near = assigned()
        for c in range(len(points)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == c]
            if own:
                points[c] = [sum(col) // len(own) for col in zip(*own)]
    near = assigned()
    total = {c: sum(d for d, m in near if m == c) for c in range(len(points))}
    return [(i, c, d, total[c], sum(total.values()), points[c]) for (i, _), (d, c) in zip(kept, near)]


def vectors(draw, n, dim):
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(draw.choice([-0.5, 0.25, 0.26, 1.0, draw.gauss(0, 1)])) for _ in range(dim)]) for i in range(n)]
    e = rows[0][1]
    rows += [(500, None), (501, [0.0] * dim), (502, e[:-1]), (503, e + [1.0]), (504, [None] + e[1:]), (505, [float("nan")] + e[1:]),
             (506, [float("inf")] + e[1:]), (507, []), (0, e), (508, e), (509, e), (None, [f(-x) for x in e])]
    return [(i, v, 1, "c", 2, 0.5) for i, v in rows]


@pytest.mark.parametrize("k, dim", [(5, 3), (16, 8), (40, 2), (1, 4)])
def test_clusters_against_every_centroid(spark, k, dim):
    rows = vectors(random.Random(k), 90, dim)
    got = centroids.clusters(spark.createDataFrame(rows, SCHEMA), k, dim, 8, 3, "1").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_clusters(rows, k, dim, 8, 3, "1")))


def test_few_or_no_vectors(spark):
    rows = vectors(random.Random(1), 2, 4)[:2]
    got = centroids.clusters(spark.createDataFrame(rows, SCHEMA), 16, 4).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(0, 0), (1, 0)]
    assert centroids.clusters(spark.createDataFrame(rows[:0], SCHEMA), 16, 4).collect() == []


def test_huge_components(spark):
    rows = [(i, [float(x), 0.0], 1, "c", 2, 0.5) for i, x in enumerate([1e30, -1e30, 1e30, 3.0, 4.0])]
    got = {r.vec_id: r for r in centroids.clusters(spark.createDataFrame(rows, SCHEMA), 2, 2).collect()}
    assert len(got) == 5 and got[0].cluster == got[2].cluster and all(r.distance is None or r.distance >= 0 for r in got.values())


@pytest.mark.parametrize("seed", range(6))
def test_tree_search_is_exact_with_ties(seed):
    draw = np.random.default_rng(seed)
    points = draw.integers(-3, 4, (draw.integers(1, 200), 3))  # many equal points and distances
    x = draw.integers(-4, 5, (400, 3))
    number, best = centroids.nearest(centroids.build(points), x)
    away = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (number == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()


def test_tree_search_prunes(monkeypatch):
    draw = np.random.default_rng(1)
    points = np.concatenate([draw.integers(-5, 5, (50, 2)) + c for c in ([0, 0], [900, 0], [0, 900], [900, 900])])
    tree, seen, plain = centroids.build(points), [], centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, b: seen.append(a.shape[0] * b.shape[1]) or plain(a, b))
    centroids.nearest(tree, points)
    assert sum(seen) < 0.5 * len(points) ** 2


def test_centroid_query_against_its_statement(spark):
    got = queries.op13_centroids(spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(queries.ORACLE_SQL["op13_centroids"]).df()
    cols = sorted(want.columns)
    assert sorted(map(repr, got[cols].values.tolist())) == sorted(map(repr, want[cols].values.tolist()))
    assert got.cluster.nunique() == 16
