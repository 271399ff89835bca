"""Small document tables with the awkward cases."""

from __future__ import annotations

import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that share names with results or with what operators use inside.
EXTRA = ", size long, score double, kept string, taken string, fingerprint string, block string, `class` int, quality string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def documents():
    """Null, empty, blank, one-word, repeated, near-equal, foreign and very long texts."""
    rng = random.Random(7)
    base = sentence(rng, 120)
    changed = base.split()
    changed[60] = "zzz"
    rows = [
        (0, base, "en", "a"),
        (1, base, "en", "a"),
        (2, " ".join(changed), "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n", "en", "b"),
        (6, "one", "en", None),
        (7, "Ünïcode wörds über ÄÖÜ 漢字 中文 " * 12, "de", "c"),
        (8, sentence(rng, 30_000), "en", "c"),
        (8, sentence(rng, 90), "en", "c"),
        (9, sentence(rng, 70), "fr", "a"),
        (9, sentence(rng, 70), "fr", "a"),
        (None, sentence(rng, 80), None, "b"),
        (10, "x" * 200_000, "en", "b"),
        (11, "one two three four five one two three four five", "en", "d"),
        (12, "12345 678 !!! ###", "en", "d"),
    ]
    rows.append(rows[10])
    return [(i, t, a, s, None if t is None else len(t)) for i, t, a, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCUMENTS)


def clashing(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(*r, 1, 2.0, "k", "t", "f", "b", 3, "q") for r in rows], DOCUMENTS + EXTRA)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
