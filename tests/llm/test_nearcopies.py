"""The near-duplicate stage against brute force, with planted near copies."""

from __future__ import annotations

import os
import random
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures  # noqa: E402
from test_pairs_and_packing import groups_of, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from tickloom.llm import nearcopies, simhash  # noqa: E402


def planted():
    """Texts with near copies on both sides of similarity 0.8; their fingerprints are mostly over 2 bits apart."""
    draw = random.Random(31)
    rows = fixtures.documents()
    for i in range(12):
        w = fixtures.sentence(draw, "aa", draw.choice([90, 200, 400])).split()
        for k in range(6):
            copy = list(w)
            for at in draw.sample(range(len(w)), max(k > 0, k * len(w) // 220)):
                copy[at] = f"new{k}"
            rows.append((1000 + 10 * i + k, " ".join(copy), "aa", "s1", 1, *fixtures.EXTRA))
    return rows


def plain_groups(rows):
    texts = [" ".join(words(t)) for _, t, *_ in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return texts, pairs, groups_of(range(len(rows)), pairs)


@pytest.mark.parametrize("block", [3, 256])
def test_one_document_of_each_group_of_near_copies_stays(spark, block):
    rows = planted()
    docs = fixtures.table(spark, rows)
    texts, pairs, group = plain_groups(rows)
    assert sum(texts[i] != texts[j] for i, j in pairs) > 50
    best = {}
    for i, g in group.items():
        rank = (rows[i][0] is None, rows[i][0] or 0)
        best[g] = min(best.get(g, (True, 1 << 60)), rank)
    want = Counter(None if null else d for null, d in best.values())
    got = nearcopies.first_of_near(docs, block=block)
    assert got.columns == docs.columns
    got = got.collect()
    assert Counter(r.doc_id for r in got) == want and set(map(tuple, got)) <= set(rows)
    if block == 256:
        assert Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
        assert nearcopies.first_of_near(fixtures.table(spark, [])).collect() == []


def test_the_stage_links_what_fingerprints_link(spark):
    """Short texts with one word of 24 changed: similarity below 0.8, fingerprints at most two bits apart."""
    draw, rows, linked = random.Random(5), [], 0
    while linked < 3:
        w = fixtures.sentence(draw, "aa", 24).split()
        for at in (11, 12, 13):
            copy = w[:at] + [w[at] + "x"] + w[at + 1:]
            a, b = (simhash.fingerprint(" ".join(x).encode()) for x in (w, copy))
            if (a ^ b).bit_count() <= 2:
                rows += [(5000 + 10 * linked + k, " ".join(x), "aa", "s1", 1, *fixtures.EXTRA) for k, x in enumerate((w, copy))]
                linked += 1
                break
    _, pairs, _ = plain_groups(rows)
    assert not pairs
    docs = fixtures.table(spark, rows)
    want = sorted(r.doc_id for r in simhash.first_of_each(docs).collect())
    assert want == [5000, 5010, 5020]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
