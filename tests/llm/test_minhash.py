import random

import numpy as np
import pytest
from conftest import FOLDER
from frames import clashing, documents, empty, fold, frame, sentence, words

from farelens.llm import minhash_join
from farelens.llm.common import table
from farelens.llm.components import components


def shingle_set(text):
    w = words(fold(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """doc_id by smallest doc_id reachable; rows: (doc_id, text)."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if a and 100 * both >= 85 * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is None, d or 0), len(s), least.get(find(i))) for i, (d, s) in enumerate(sets))


def report(df):
    return sorted(
        ((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id)
        for r in minhash_join.duplicate_report(df).collect()
    )


def similar_texts(n, edits, seed):
    """A text and copies of it with up to ``edits`` words changed, so that only some are linked."""
    rng = random.Random(seed)
    base = sentence(rng, 150).split()
    out = [" ".join(base)]
    for i in range(n - 1):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"new{i}"
        out.append(" ".join(copy))
    return out


def test_table_equals_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    assert report(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    rows = documents()
    assert report(clashing(spark)) == brute([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("block", [1024, 20])
def test_large_group_is_compared_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_join, "BLOCK_CLASSES", block)
    texts = similar_texts(90, 14, 3) + similar_texts(12, 6, 4) + [sentence(random.Random(i), 80) for i in range(30)]
    rows = [(i * 31 % 997, t, None, None, 0) for i, t in enumerate(texts)]
    assert report(frame(spark, rows)) == brute([(r[0], r[1]) for r in rows])


def test_similarity_at_the_edge():
    a = np.arange(100, dtype=np.uint64)
    assert minhash_join.similar(a, a[:85]) and not minhash_join.similar(a, a[:84])
    both = np.arange(8, 100, dtype=np.uint64), np.arange(0, 92, dtype=np.uint64)
    assert minhash_join.similar(*both) == (100 * 84 >= 85 * 100)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_first_of_each_group(spark):
    df = clashing(spark)
    left = minhash_join.first_of_each_group(df)
    assert left.columns == df.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect())
    # 1 and 2 resemble 0; the second of the equal rows 9 goes; texts without words stay.
    expected = [0, 3, 4, 5, 6, 7, 8, 8, 9, 9, 10, 11, 12]
    assert ids == [(False, i) for i in expected] + [(True, 0)]


def test_empty_table(spark):
    assert report(empty(spark)) == []
    assert minhash_join.first_of_each_group(empty(spark)).count() == 0


def test_one_of_each_group_also_with_shared_or_missing_ids(spark):
    a, b, c = (sentence(random.Random(i), 120) for i in range(3))
    near = lambda text: " ".join(["zzz", *text.split()[1:]])
    texts = [(5, a), (5, near(a)), (6, a), (None, b), (None, b.upper()), (None, b.replace(" ", "  ")), (None, near(b))]
    texts += [(None, c), (7, near(c)), (7, c), (8, ""), (8, " "), (None, ""), (None, "")]
    left = minhash_join.first_of_each_group(frame(spark, [(d, t, None, None, 0) for d, t in texts])).collect()
    ids = [r.doc_id for r in left if r.text.strip()]
    assert sorted(ids, key=str) == [5, 7, None]
    assert len(left) == 3 + 4
