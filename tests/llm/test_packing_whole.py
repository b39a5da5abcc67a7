"""Added tokens and many small sources in packing."""

from __future__ import annotations

import os
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

from tickloom.llm import packing  # noqa: E402
from tickloom.llm.queries import VOCABULARY  # noqa: E402


def packed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return packing.pack(docs, VOCABULARY, public_tokenizers.PATTERN, **options).collect()


def test_added_tokens_are_those_of_the_tokenizers_file(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a\n <|endoftext|>  \n b", "<|endoftext|", "don't <|ENDOFTEXT|>", ""]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 1]
    got = defaultdict(list)
    for r in sorted(packed(spark, [(i, x, "s") for i, x in enumerate(texts)]), key=lambda r: r.start):
        got[r.doc_id] += np.frombuffer(r.ids, "<u2").tolist()
        assert r.doc_tokens == len(want[r.doc_id])
    assert got == want


@pytest.mark.parametrize("sources,fan", [(300, 256), (300, 8), (40, 256)])
def test_windows_hold_many_small_sources_in_proportion(spark, sources, fan):
    rows = [(i, "one two three " * (20 + i % 7), f"s{i % sources}" if i % sources else None) for i in range(4 * sources)]
    if sources == 300:
        rows += [(10_000 + i, "of the large one " * 300, "large") for i in range(10)]
    got = packed(spark, rows, fan=fan, min_share=1 / 16)
    pieces, windows, total, fill = defaultdict(list), defaultdict(Counter), Counter(), Counter()
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id][r.source] += r.length
        total[r.source] += r.length
        fill[r.sequence_id] += r.length
    assert set(pieces) == {r[0] for r in rows}
    for r in got:
        assert r.start == sum(n for s, n in pieces[r.doc_id] if s < r.start)
    everything = sum(total.values())
    assert sum(r.doc_tokens for r in {r.doc_id: r for r in got}.values()) == everything
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for x in spans.values():
        at = 0
        for a, n in sorted(x):
            assert a == at
            at += n
    full = [w for w in windows if fill[w] == 2048]
    assert len(full) == everything // 2048 and len(total) >= sources
    levels = 1 if sources <= fan else 2 if sources <= fan * fan else 3
    for s, n in total.items():
        share = 2048 * n / everything
        if s != "large":
            assert all(abs(windows[w][s] - share) <= levels * (share + 3) for w in full), (s, share)
