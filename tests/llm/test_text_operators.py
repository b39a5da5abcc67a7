"""Licences, language, secrets, sharding and mixing against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import sys
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import fixtures  # noqa: E402

from tickloom.llm import langid, licences, mixing, secrets, sharding  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def same_rows(a, b):
    assert Counter(map(repr, a)) == Counter(map(repr, b))


# --- licences -------------------------------------------------------------------------------------------------

def test_licences_against_word_lists(spark):
    rows = fixtures.documents()
    rows += [(200 + i, t, "aa", "s", 1, *fixtures.EXTRA) for i, t in enumerate([
        "apache license apache LICENSE", "cc--by//cc by", "MIT\nLicense", "xmit license", "mit licenses", "mit äpache license",
        "The GNU General Public License; the gnu general public licence", "cc by" * 3])]
    got = licences.licence_scan(fixtures.table(spark, rows)).collect()
    want = []
    for d, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        hits = [(i, label) for phrase, label in licences.BASE for i in range(len(w))
                if w[i:i + len(phrase.split())] == phrase.split()]
        want.append((d, len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
                     ",".join(sorted({x for _, x in hits}))))
    same_rows([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_licence_expressions():
    def value(text):
        terms = licences.evaluate(licences.postfix(text))
        return terms and (terms.text, terms.permissive)

    assert value("mit or gpl-2.0-only and isc") == ("mit or gpl-2.0-only and isc", True)
    assert value("(mit or gpl-2.0-only) and gpl-3.0-only") == ("(mit or gpl-2.0-only) and gpl-3.0-only", False)
    assert value("gpl-2.0-only with classpath-exception-2.0 or mit") == ("gpl-2.0-only with classpath-exception-2.0 or mit", True)
    assert value("mit and") == ("mit", True) and value("mit and (isc") == ("mit", True)
    assert value("mit */") == ("mit", True) and value(") mit") is None and value("") is None and value("and mit") is None
    found = licences.scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode")
    assert found["expressions"] == ["mit or apache-2.0"] and found["permissive"] and found["score"] == 1.0
    assert found["labels"] == "apache-2.0,mit"
    # every tree of random expressions evaluates as Python does
    draw = random.Random(4)
    for _ in range(200):
        n = draw.randint(1, 6)
        ids = draw.choices(["mit", "isc", "gpl-3.0-only", "agpl-3.0-only"], k=n)
        text = ids[0]
        for x in ids[1:]:
            text = draw.choice([f"{text} {{}} {x}", f"({text}) {{}} {x}", f"{x} {{}} ({text})"]).format(draw.choice(["and", "or"]))
        plain = re.sub(r"[a-z0-9][a-z0-9.-]+(?![a-z])", lambda m: m[0] if m[0] in ("and", "or") else str(m[0] in licences.PERMISSIVE), text)
        assert value(text)[1] == eval(plain)  # noqa: S307


def test_licences_of_very_long_texts():
    """200,000 notices and operands in one text: quadratic work would take minutes."""
    n = 200_000
    begun = time.perf_counter()
    found = licences.scan(b"x the mit license " * n)
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"]) == (4 * n, n, 2, 4 * n - 2)
    flat = licences.scan(b"SPDX-License-Identifier: " + b" or ".join(b"a%d" % i for i in range(n)) + b" and")
    assert flat["expressions"] == [" or ".join(f"a{i}" for i in range(n))] and flat["labels"].count(",") == n - 1
    deep = licences.scan(b"SPDX-License-Identifier: " + b" and (".join([b"mit or isc"] * n) + b")" * (n - 1))
    assert deep["expressions"][0].count("mit") == n and deep["permissive"]
    assert time.perf_counter() - begun < 60


def test_licences_empty_table(spark):
    assert licences.licence_scan(fixtures.table(spark, [])).collect() == []


# --- language -------------------------------------------------------------------------------------------------

def best_path(scores, penalty):
    n, k = scores.shape
    return max(sum(scores[t, p[t]] for t in range(n)) - penalty * sum(p[t] != p[t - 1] for t in range(1, n))
               for p in itertools.product(range(k), repeat=n))


def test_viterbi_and_its_shortcut_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(60):
        many = [-rng.random((rng.integers(1, 7), 3)) * 6 for _ in range(4)]
        for s, path in zip(many, langid.viterbi(many, 4.0)):
            value = s[np.arange(len(s)), path].sum() - 4.0 * (np.diff(path) != 0).sum()
            assert value == pytest.approx(best_path(s, 4.0))
        scores, text = np.concatenate(many), np.repeat(np.arange(4), [len(s) for s in many])
        lead = np.array([s.sum(axis=0).argmax() for s in many])
        gain = langid._switch_gain(scores, lead, text)
        for i, s in enumerate(many):
            if gain[text == i].max() <= 2.0:
                assert s[:, lead[i]].sum() == pytest.approx(best_path(s, 4.0))


def test_long_texts_are_labelled_in_blocks_as_at_once(monkeypatch):
    draw = np.random.default_rng(5)
    words = [["abra", "kata", "bora"], ["zyxo", "wuvu", "qexe"], ["mnom", "lill", "momi"]]
    table = np.full((1 << langid.BITS, 3), -9.0, np.float32)
    for k, own in enumerate(words):
        table[langid.words_of([" ".join(own)]).buckets, k] = -1.0
    model = langid.LanguageModel(["a", "b", "c"], table, np.zeros((langid.N_SCRIPTS, 3)))
    texts = [""] + [" ".join(draw.choice(words[draw.integers(3)]) for _ in range(draw.integers(1, 9)) for _ in range(draw.integers(1, 40)))
                    for _ in range(40)] + [None, " ".join(words[0] * 50 + words[1] * 60 + words[0] * 2), "́ 1 2"]
    want = langid.predict(model, texts)
    assert len({s["lang"] for r in want for s in r["spans"]}) == 3 and max(len(r["spans"]) for r in want) > 1
    monkeypatch.setattr(langid, "CELLS", 100)
    assert langid.predict(model, texts) == want


def test_one_long_text_among_short_ones_stays_small():
    draw = np.random.default_rng(6)
    scores = [np.minimum(draw.normal(-2, 2, (n, 50)), 0) for n in [40_000] + [60] * 150]
    tracemalloc.start()
    paths = langid.viterbi(scores, 4.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(p) for p in paths] == [40_000] + [60] * 150
    assert peak < 4 * sum(s.nbytes for s in scores)
    for i in (0, 7):
        assert (langid.viterbi([scores[i]], 4.0)[0] == paths[i]).all()


def test_language_of_whole_and_mixed_texts(spark):
    docs = fixtures.table(spark, fixtures.documents(n=150))
    out = {r.doc_id: r for r in langid.language_id(docs).collect() if r.doc_id is not None}
    truth = {d: lang for d, t, lang, *_ in fixtures.documents(n=150) if d is not None and d < 100 and d % 7 > 1 and t and len(t) > 80}
    held = [d for d in truth if out[d].held_out]
    assert {d for d in out if out[d].held_out} == {d for d in out if zlib.crc32(str(d).encode()) % 5 == 0}
    assert len(held) > 8 and np.mean([out[d].lang_pred == truth[d] for d in held]) > 0.9
    for d in (110, 111, 112, 113):
        assert (out[d].lang_pred, out[d].score, out[d].spans) == ("und", 0.0, [])
    assert all(0 <= r.score <= 1 for r in out.values()) and out[118].lang_pred != "und"
    model = langid.learn(docs)
    draw = random.Random(9)
    a, b = fixtures.sentence(draw, "aa", 40), fixtures.sentence(draw, "bb", 40)
    spans = langid.predict(model, [f"{a}\n{b}"])[0]["spans"]
    assert [s["lang"] for s in spans] == ["aa", "bb"] and abs(spans[1]["start"] - len(a)) < 25


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "слово дело мир " * 5, "ru", "s", 1, *fixtures.EXTRA) for i in range(5)]
    rows += [(10 + i, "word deal world " * 5, "en", "s", 1, *fixtures.EXTRA) for i in range(5)]
    model = langid.learn(fixtures.table(spark, rows))
    found = langid.predict(model, ["мор world", "зюйд " * 9, "deal " * 9, None, "漢字"])
    assert [f["lang_pred"] for f in found[1:4]] == ["ru", "en", "und"] and found[4]["lang_pred"] in ("ru", "en")


def test_language_without_anything_to_learn(spark):
    rows = [(1, "some words", None, "s", 1, *fixtures.EXTRA)]
    assert [r.lang_pred for r in langid.language_id(fixtures.table(spark, rows)).collect()] == ["und"]
    assert langid.language_id(fixtures.table(spark, [])).collect() == []


# --- secrets --------------------------------------------------------------------------------------------------

def plain_spans(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                         r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


SECRETS = ["Token : 'abcdefgh", "TOKEN=short", "ſecret=abcdefghij", "toKen=abcdefghij", "api_key=a1b2c3d4e5", "ApiKey:\"x\"",
           "secret: token: abcdefghijkl", "é" * 9 + "password=0123456789abcdef0123456789abcdef01", "AKIAAKIAAKIAAKIA AKIA123",
           "z" * 70_000 + " passwd = qwertyuiop", "0123456789abcdef" * 3 + "G"]


def test_secret_patterns_against_plain_search(spark):
    rows = fixtures.documents() + [(300 + i, t, "aa", "s", 1, *fixtures.EXTRA) for i, t in enumerate(SECRETS)]
    got = secrets.secret_scan(fixtures.table(spark, rows)).collect()
    want = []
    for d, t, *_ in rows:
        base = plain_spans(t or "")
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        n = Counter(k for _, k, _ in base)
        want.append((d, n[0], n[1], n[2], hashlib.sha256(listed.encode()).hexdigest()))
    same_rows([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], want)
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("field")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_field_decodes_the_best_path_and_skips_only_what_is_outside():
    rng = np.random.default_rng(5)
    for _ in range(80):
        move = rng.normal(size=(3, 3)) * 2
        move[secrets.O, secrets.I] = -1e4
        field = secrets.Field(np.zeros((secrets.N_FEATURES, 3)), move, np.array([0.3, -1e4, 0.1]))
        s = rng.normal(size=(rng.integers(1, 7), 3)) * 2 - [1.5, 1.5, 0]

        def value(p, s=s, field=field):
            return field.first[p[0]] + sum(s[t, p[t]] for t in range(len(p))) + sum(field.move[p[t - 1], p[t]] for t in range(1, len(p)))

        best = max(itertools.product(range(3), repeat=len(s)), key=value)
        assert value(tuple(field.decode(s))) == pytest.approx(value(best))
        if not field.could_gain(s).any():
            assert value((secrets.O,) * len(s)) == pytest.approx(value(best))


def test_field_finds_secrets_that_no_pattern_names_and_leaves_prose_alone(spark):
    draw = random.Random(3)
    hexes = "".join
    rows = []
    for i in range(300):
        text = fixtures.sentence(draw, "aa", 60)
        if i % 3 == 0:
            text += " token = \"" + hexes(draw.choices("0123456789abcdef", k=36)) + "\" " + fixtures.sentence(draw, "aa", 10)
        rows.append((i, text, "aa", "s", 1, *fixtures.EXTRA))
    field = secrets.learn(fixtures.table(spark, rows))
    hidden = "some words bearer \"" + hexes(draw.choices("0123456789abcdefABCDEF", k=36)) + "\" and more words"
    new = [(1, hidden, "aa", "s", 1, *fixtures.EXTRA), (2, fixtures.sentence(draw, "aa", 300), "aa", "s", 1, *fixtures.EXTRA)]
    out = {r.doc_id: r for r in secrets.secret_scan(fixtures.table(spark, new), field).collect()}
    kind, start, end = out[1].spans.split(":")
    assert kind == "field" and hidden[int(start):int(end)] == hidden.split('"')[1] and out[2].spans == ""


def test_spans_of_long_texts_and_code_points():
    """Field spans count code points, keep off pattern spans, and many of them take no quadratic time."""
    emit = np.zeros((secrets.N_FEATURES, 3))
    emit[secrets.OFFSETS[1] + 1:secrets.OFFSETS[2], secrets.B] = 5.0  # every token with a digit begins a secret
    field = secrets.Field(emit, np.zeros((3, 3)) + np.array([0, -9, 0]), np.array([0.0, -9.0, 0.0]))
    text = "é x1 password=abcdefgh9 ü z2"
    assert secrets.scan(pa.array([text]), field) == [[(2, 3, 4, 2), (5, 0, 23, 14), (26, 3, 28, 26)]]
    begun = time.perf_counter()
    many = secrets.scan(pa.array([text * 30_000]), field)[0]
    assert [sum(k == n for _, k, _, _ in many) for n in (0, 3)] == [30_000, 60_000]  # x1, and z2 with the next copy's é
    assert time.perf_counter() - begun < 60


def test_copies_and_many_secrets_leave_room_for_other_windows(spark):
    draw = random.Random(8)
    rows = [(i, f"password={draw.getrandbits(80):x} then {i} words", "aa", "s", 1, *fixtures.EXTRA) for i in range(400)]
    rows += [(1000 + i, f"nothing to see on page {i % 50} here", "aa", "s", 1, *fixtures.EXTRA) for i in range(400)]
    seen = []
    true_train = secrets.train

    def spy(windows, tags, **kw):
        seen.append(((tags == secrets.B).any(axis=1).sum(), len(tags), len(np.unique(np.concatenate([windows.reshape(len(tags), -1), tags], 1), axis=0))))
        return true_train(windows, tags, **kw)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(secrets, "train", spy)
        secrets.learn(fixtures.table(spark, rows), windows=40)
    (positive, n, different), = seen
    assert 0 < positive < n <= 40 and different == n


def test_redaction_keeps_rows_and_columns(spark):
    docs = fixtures.table(spark)
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(r.text is None or not plain_spans(r.text) and r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in rows if r.text and "[REDACTED]" in r.text} == {d for d, t, *_ in fixtures.documents() if plain_spans(t or "")}


def test_secrets_empty_table(spark):
    assert secrets.secret_scan(fixtures.table(spark, [])).collect() == []


# --- sharding -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("slice_rows", [5, 20_000])
def test_shards_match_the_mixture(spark, slice_rows):
    rows = fixtures.documents(n=200)
    got = sharding.stratified_shards(fixtures.table(spark, rows), shards=8, slice_rows=slice_rows).collect()
    same_rows([(r.doc_id, r.size, r.text_crc32) for r in got],
              [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows])
    shards, mixture = defaultdict(list), defaultdict(Counter)
    for r in got:
        shards[r.shard].append(r.slot)
        mixture[r.source][r.shard] += 1
    assert sorted(shards) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for source, n in mixture.items():  # every source within two rows of its proportion
        assert all(abs(n[s] - sum(n.values()) / 8) <= 2 for s in range(8)), source
    # fractional ranks do not fall along the shards and their slots
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.frac_rank for r in order] == sorted(r.frac_rank for r in got)


def test_shards_do_not_depend_on_slices(spark):
    docs = fixtures.table(spark, fixtures.documents(n=100))
    a, b = (sharding.stratified_shards(docs, slice_rows=n).select("doc_id", "text_crc32", "shard", "slot").collect() for n in (7, 10_000))
    same_rows([r for r in a if r.doc_id not in (5, 8)], [r for r in b if r.doc_id not in (5, 8)])
    assert sharding.stratified_shards(fixtures.table(spark, [])).collect() == []


# --- mixing ---------------------------------------------------------------------------------------------------

def test_mixing_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(mixing.oracle_sql()).fetchall()
    got = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet")).selectExpr(
        "row.doc_id", "source", "lang", "topic", "tokens", "round(probability, 6)", "kept").collect()
    same_rows([tuple(r) for r in got], want)


def raked(spark, docs, **options):
    rows = docs.select("source", "lang", mixing.topic_of("text").alias("topic"), mixing.tokens_of("text").alias("tokens"))
    cells = rows.groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    return mixing.rake(cells, **options)


def test_expected_tokens_meet_the_targets(spark):
    docs = fixtures.table(spark, [r for r in fixtures.documents(n=400) if r[0] is not None and r[3] and 100 < len(r[1] or "") < 20_000])
    targets = {"source": {"hot": 0.1, "s0": 0.2, "s1": 0.2, "s2": 0.2, "s3": 0.2, "s4": 0.1}}
    out = mixing.report(raked(spark, docs, targets=targets, rate=0.2)).collect()
    own = {r.value: r for r in out if r.dimension == "source"}
    total = sum(r.expected for r in own.values())
    assert {v: r.expected / total for v, r in own.items()} == pytest.approx(targets["source"], rel=1e-6)
    assert all(abs(r.error) < 1e-6 for r in out) and len({r.dimension for r in out}) == 3


def skewed():
    """One source with half of all tokens, ten with a thousandth each; rare languages inside rare sources."""
    draw = random.Random(4)
    rows = []
    for i in range(900):
        big = i % 2 == 0
        source = "hot" if big else ("big", "wide", f"tiny{i % 10}")[draw.choice([0, 0, 0, 1, 1, 2])]
        n = 400 if big else 8 if source.startswith("tiny") else 300
        lang = draw.choice(["aa"] * 12 + ["bb"] * 3 + ["cc"])
        rows.append((i, draw.choice(["", "a@b ", "!! ", "x | y "]) + "w " * n, lang, source, 1, *fixtures.EXTRA))
    return rows


@pytest.mark.parametrize("together", [100_000, 0])
def test_full_cells_leave_their_rest_to_the_others(spark, monkeypatch, together):
    monkeypatch.setattr(mixing, "TOGETHER", together)
    cells = raked(spark, fixtures.table(spark, skewed()), rate=0.6).collect()
    assert all(0 <= r.expected <= r.tokens * (1 + 1e-12) for r in cells)
    assert sum(r.expected > r.tokens * (1 - 1e-9) for r in cells) > 3  # some are full
    for i, d in enumerate(mixing.DIMENSIONS):
        tokens, expected, target = defaultdict(float), defaultdict(float), {}
        for r in cells:
            tokens[r[d]] += r.tokens
            expected[r[d]] += r.expected
            target[r[d]] = r[f"target_{d}"]
        # the feasible target by bisection on the common factor
        wanted = {v: (n / sum(tokens.values())) ** mixing.FLATNESS[d] for v, n in tokens.items()}
        low, high = 0.0, 1e12
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(tokens[v], mid * w) for v, w in wanted.items()) < 0.6 * sum(tokens.values()) else (low, mid)
        feasible = {v: min(tokens[v], high * w) for v, w in wanted.items()}
        assert target == pytest.approx(feasible, rel=1e-6)
        assert dict(expected) == pytest.approx(feasible, rel=1e-3)


def test_sampled_tokens_come_near_the_expected_ones(spark):
    docs = fixtures.table(spark, skewed())
    rows = mixing.mixed(docs).collect()
    want = defaultdict(float)
    for r in rows:
        want[r.source] += r.tokens * r.probability
    for source in ("hot", "big", "wide"):
        got = sum(r.tokens for r in rows if r.source == source and r.kept)
        assert got == pytest.approx(want[source], rel=0.25)


def test_targets_that_cannot_be_met_are_reported(spark):
    docs = fixtures.table(spark, skewed())
    out = mixing.report(raked(spark, docs, targets={"source": {"tiny1": 1.0}})).collect()
    own = {r.value: r for r in out if r.dimension == "source"}
    assert own["tiny1"].full and own["hot"].expected == 0 and own["hot"].target == 0
    assert any(r.error is not None and abs(r.error) > 1e-3 for r in out if r.dimension == "lang")  # contradicts one source


def test_sampling_keeps_columns_and_every_awkward_row(spark):
    docs = fixtures.table(spark)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    same_rows([r.doc_id for r in kept.collect()], [r.row.doc_id for r in rows if r.kept])
    assert len({r.kept for r in rows if r.row.doc_id == 5}) == 1  # repeated rows together
    assert mixing.mixed(fixtures.table(spark, [])).collect() == []
