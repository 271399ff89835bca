import re

import pytest
from conftest import FOLDER
from frames import clashing, documents, empty, frame, words

from farelens.llm import weak_quality
from farelens.llm.common import table
from farelens.llm.queries import QUERIES


def brute(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p + j for at in windows.values() if len(at) > 1 for p in at for j in range(3)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def test_counts_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    for r in QUERIES["op9_quality"](spark, FOLDER).collect():
        assert counts(r) == brute(texts[r.doc_id])
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (r.kept and failed)


def test_awkward_texts(spark):
    rows = documents()
    rows += [(100 + i, t, None, None, 0) for i, t in enumerate(["a b c a b c a", "a a a a", "x\nx\n\n \nx\r\nx", "a b c d a b c"])]
    out = weak_quality.quality_report(clashing(spark, rows)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, counts(r)) for r in out)
    assert got == sorted((i is None, i or 0, brute(t)) for i, t, *_ in rows)


def test_agrees_with_labels(spark):
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    judged = QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").filter("NOT base_failed").select("doc_id", "kept")
    rows = judged.join(labels, "doc_id").collect()
    right = sum(r.kept == bool(r.quality) for r in rows)
    assert right >= 0.97 * len(rows)


def test_fit_keeps_the_good_class_good():
    posterior = weak_quality.fit({"ggg": 900, "bgg": 60, "gbb": 30, "g--": 10}, caps=[0.001, 0.001, 0.05])
    assert posterior["ggg"] > 0.9 and posterior["bgg"] < 0.5 and posterior["gbb"] < 0.1
    assert weak_quality.fit({}) == {}


def test_keep_good_returns_rows_as_they_came(spark):
    df = clashing(spark)
    kept = weak_quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r["quality"] for r in kept.collect()} == {"q"}


@pytest.mark.parametrize("call", [weak_quality.quality_report, weak_quality.keep_good])
def test_empty_table(spark, call):
    assert call(empty(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = weak_quality.voted(weak_quality.measured(frame(spark)))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
