"""Licence scans: identifier tags, notice phrases and licence expressions.

One Aho-Corasick automaton finds all phrases in the word sequence of a text; where it meets the words
``spdx license identifier``, the rest of that line is parsed as a licence expression by a shunting yard
and evaluated.

Words: the text's UTF-8 with A-Z lower-cased, runs of digits, a-z and non-ASCII characters. A phrase
occurs where its words stand consecutively, whatever separates them; overlapping places all count.

Null or empty text: no words, no labels, score 0. Expressions that do not parse are cut to the longest
prefix that does; none is ignored. Rows are independent, so repeated rows give repeated results. Time grows
linearly with a text, its hits and the operands of a tag, however many there are.
"""

from __future__ import annotations

import functools
import re
from collections import deque
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_batches, utf8

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Further notice phrases.
NOTICES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("boost software license", "bsl"),
    ("isc license", "isc"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by sa", "cc-by-sa"),
    ("cc0", "cc0"),
    ("creative commons attribution", "cc-by"),
    ("public domain", "public-domain"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under the apache license", "apache"),
    ("all rights reserved", "reserved"),
)
# Identifiers whose terms let a text be reused without share-alike duties.
PERMISSIVE = frozenset(
    "0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-4.0 cc0-1.0 isc mit unlicense zlib".split())
TAG = "spdx license identifier"
_TAG_LINE = re.compile(rb"spdx-license-identifier:[\x20\t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*|\S")
#: Operators by how tightly they bind.
_BINDS = {"or": 1, "and": 2, "with": 3}
_SPACED = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else 0x20 for c in range(256))


def postfix(text: str) -> list[str]:
    """Shunting yard: the postfix form of the longest valid expression that ``text`` begins with.

    ``with`` takes identifiers on both sides and binds tightest, then ``and``, then ``or``."""
    tokens = _TOKEN.findall(text)
    out, valid = _yard(tokens)
    return out if valid == len(tokens) else _yard(tokens[:valid])[0]


def _yard(tokens: list[str]) -> tuple[list[str], int]:
    """The postfix form of the tokens read until one does not fit, and how many of them make a valid expression."""
    out: list[str] = []
    ops: list[str] = []
    operand, still_open, valid = True, 0, 0  # operand: what may come next
    for n, tok in enumerate(tokens, 1):
        if tok == "(":
            if not operand or ops and ops[-1] == "with":
                break
            ops.append(tok)
            still_open += 1
        elif tok == ")":
            if operand or not still_open:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            still_open -= 1
        elif tok in _BINDS:
            if operand or tok == "with" and (out[-1] in _BINDS or ops and ops[-1] == "with"):
                break
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[tok]:
                out.append(ops.pop())
            ops.append(tok)
            operand = True
            continue
        elif operand and re.match(r"[a-z0-9]", tok):
            out.append(tok)
            operand = False
        else:
            break
        if not operand and not still_open:
            valid = n
    return out + ops[::-1], valid


@dataclass
class Terms:
    """An evaluated expression: the parts of its normal text, its identifiers, whether some choice is permissive."""

    parts: deque[str]
    ids: set[str] = field(default_factory=set)
    permissive: bool = False
    binds: int = 4

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def inside(self, level: int) -> deque[str]:
        """The parts as an operand of an operator that binds by ``level``."""
        if self.binds < level:
            self.parts.appendleft("(")
            self.parts.append(")")
        return self.parts


def evaluate(rpn: list[str]) -> Terms | None:
    """``or`` lets the reader choose, ``and`` demands both, ``with`` keeps the licence and names an exception.

    The shorter operand is always added to the longer one, so long expressions take no quadratic time."""
    stack: list[Terms] = []
    for tok in rpn:
        if tok not in _BINDS:
            stack.append(Terms(deque([tok]), {tok}, tok.rstrip("+") in PERMISSIVE))
            continue
        b, a = stack.pop(), stack.pop()
        level = _BINDS[tok]
        left, right = a.inside(level), b.inside(level)
        if len(left) >= len(right):
            left.append(f" {tok} ")
            left.extend(right)
        else:
            right.appendleft(f" {tok} ")
            right.extendleft(reversed(left))
        few, many = sorted((a.ids, b.ids if tok != "with" else set()), key=len)
        many |= few
        ok = {"or": a.permissive or b.permissive, "and": a.permissive and b.permissive, "with": a.permissive}[tok]
        stack.append(Terms(left if len(left) > len(right) else right, many, ok, level))
    return stack[0] if stack else None


@functools.lru_cache(maxsize=4)
def _automaton(base: tuple, notices: tuple) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, bool]]] = {}
    for pairs, is_base in ((base, True), (notices, False)):
        for phrase, label in pairs:
            found.setdefault(phrase, []).append((label, is_base))
    found.setdefault(TAG, [])
    auto = ahocorasick.Automaton()
    for phrase, labels in found.items():
        auto.add_word(f" {phrase} ", (len(phrase.split()), phrase == TAG, tuple(labels)))
    auto.make_automaton()
    return auto


def scan(raw: bytes | None, base: tuple = BASE, notices: tuple = NOTICES) -> dict:
    """Every finding in one text."""
    lower = (raw or b"").lower()
    words = lower.translate(_SPACED).split()
    line = f" {b' '.join(words).decode()} "
    base_labels, labels, hits, tagged = set(), set(), 0, False
    n_base, first_word, last_word = 0, None, None
    seen, ended = 0, 0  # characters behind the last hit, words ended there; hits come in order of their ends
    for end, (length, is_tag, found) in _automaton(base, notices).iter(line):
        tagged |= is_tag
        hits += len(found)
        ended += line.count(" ", seen, end)
        seen = end
        for label, is_base in found:
            labels.add(label)
            if is_base:
                first = ended - length
                base_labels.add(label)
                n_base += 1
                first_word = first if first_word is None else min(first_word, first)
                last_word = first if last_word is None else max(last_word, first)
    expressions: list[str] = []
    permissive = None
    if tagged:
        for m in _TAG_LINE.finditer(lower):
            if terms := evaluate(postfix(m[1].decode(errors="replace"))):
                expressions.append(terms.text)
                labels |= terms.ids
                permissive = terms.permissive if permissive is None else permissive and terms.permissive
    score = 1.0 if expressions else 1.0 - 0.5 ** min(hits, 50)
    return {
        "n_words": len(words), "n_base": n_base, "first_word": first_word, "last_word": last_word,
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels)), "score": score, "expressions": expressions, "permissive": permissive,
    }


_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_()),
])
_DDL = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,"
        "score:double,expressions:array<string>,permissive:boolean>")


def licence_scan(docs: DataFrame, base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of base phrases), first_word and last_word
    (their smallest and largest start), base_labels, labels, score, expressions, permissive (whether all
    tagged expressions allow a permissive choice; null without a tag)."""

    @F.arrow_udf(_DDL)
    def scanned(text: pa.Array) -> pa.Array:
        return pa.array([scan(t, base, notices) for t in utf8(text)], type=_RESULT)

    return text_batches(docs).select("doc_id", scanned("text").alias("_s")).select("doc_id", "_s.*")
