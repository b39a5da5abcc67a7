"""Small document tables with every awkward case."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, row string, ids string, "
          "key string, words string, root string, kept string, tokens string, vector string, found string")
#: Values of the extra columns, whose names clash with names the operators use themselves.
EXTRA = (7, "r", "i", "k", "w", "t", "x", "z", "v", "f")

SYLLABLES = {
    "aa": "the ing and tion er ly wh of th re".split(),
    "bb": "der ung ich sch ein heit zu ge von ö".split(),
    "cc": "que ción los mente ado ñ una por ez ll".split(),
}


def sentence(draw: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    passage = sentence(draw, "aa", 60)
    for i in range(n):
        lang = draw.choice(list(SYLLABLES))
        lines = [sentence(draw, lang, draw.randint(3, 70)) for _ in range(draw.randint(1, 6))]
        if i % 7 == 0:
            lines.insert(draw.randint(0, len(lines)), passage)
        if i % 7 == 1:  # a near copy of the passage
            w = passage.split()
            w[i % len(w)] = "changed"
            lines.append(" ".join(w))
        if i % 9 == 2:
            lines.append("contact password=ab12cd34ef56ab and AKIA" + "Q1W2E3R4T5Y6U7I8 or " + "0f" * 20)
        if i % 11 == 3:
            lines.append("Licensed under the Apache License, CC BY-NC and the MIT License")
        rows.append((i, "\n".join(lines), lang, "hot" if i % 3 == 0 else f"s{i % 5}"))
    text = rows[5][1]
    rows += [
        (100, text, "aa", "hot"), (101, text, "aa", None), (102, text + " end", "bb", "s1"),  # copies
        (110, None, None, None), (111, "", "aa", "s1"), (112, " \n\t ", "bb", "s2"), (113, "!!! 123 ---", "cc", "s3"),
        (114, "x", "aa", "hot"), (115, "two words", "aa", "hot"), (116, "Ǆ ÄÖ ß İ K ſecret 漢字 שלום \U0001f600", "bb", "s4"),
        (117, "long " * 30_000, "aa", "hot"), (118, "y" * 50_000, "aa", "hot"),
        (None, sentence(draw, "aa", 40), "aa", "s1"), (None, sentence(draw, "bb", 40), "bb", None), (None, None, None, "hot"),
        rows[5], rows[5], rows[8],  # rows that repeat in full
    ]
    return [(d, t, lang, source, None if t is None else len(t), *EXTRA) for d, t, lang, source in rows]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
