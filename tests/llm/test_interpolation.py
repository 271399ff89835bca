import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import FOLDER
from frames import clashing, documents, empty, fold, frame, words

from farelens.llm import interpolation
from farelens.llm.common import table


def brute(rows):
    """The same model from counters over whole texts."""
    texts = [(d, [*words(fold(t)), None]) for d, t in rows]
    part = [interpolation.part_of(d) for d, _ in texts]

    def count(parts):
        word, pair, context = Counter(), Counter(), Counter()
        for (_, tokens), p in zip(texts, part, strict=True):
            if p in parts:
                for v, w in zip(["start", *tokens], tokens, strict=False):
                    word[w] += 1
                    pair[v, w] += 1
                    context[v] += 1
        return word, pair, context

    word, pair, context = count((interpolation.KEPT, interpolation.DELETED))
    k_word, k_pair, k_context = count((interpolation.KEPT,))
    # A word is a context as often as it occurs; the end never is one.
    n, v = sum(word.values()), len(word)
    uniform, cells = 1 / (v + 1), Counter()
    n_kept = sum(k_word.values())
    rounded = lambda p: round(math.log2(p) * interpolation.STEPS_PER_OCTAVE) if p > 0 else interpolation.NEVER
    for (_, tokens), p in zip(texts, part, strict=True):
        if p == interpolation.DELETED:
            for c, w in zip(["start", *tokens], tokens, strict=False):
                seen = k_context[c]
                bucket = int(interpolation.bucket_of(np.array([seen]))[0])
                cells[bucket, rounded(k_pair[c, w] / max(seen, 1)), rounded(k_word[w] / max(n_kept, 1))] += 1
    table_ = pd.DataFrame([(*k, m) for k, m in cells.items()], columns=["bucket", "high", "low", "n"])
    weights = interpolation.learn_mixture(table_, uniform)
    out = []
    for (d, tokens), p in zip(texts, part, strict=True):
        base = score = 0.0
        for c, w in zip(["start", *tokens], tokens, strict=False):
            base += math.log10((word[w] + 0.5) / (n + 0.5 * (v + 1)))
            x = weights[int(interpolation.bucket_of(np.array([context[c]]))[0])]
            score += math.log10(x[0] * pair[c, w] / max(context[c], 1) + x[1] * word[w] / n + x[2] * uniform)
        known = sum(word[w] > 0 for w in tokens)
        out.append((d, p == interpolation.HELD_OUT, len(tokens), known, n, base, score))
    return out


def ordered(rows):
    return sorted((tuple((x is None, x or 0) for x in r[:5]), r[5], r[6]) for r in rows)


def same(got, expected):
    got, expected = ordered(map(tuple, got)), ordered(expected)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9)


@pytest.mark.parametrize("shard", [1_500_000, 2000])
def test_table_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(interpolation, "SHARD_TOKENS", shard)
    docs = table(spark, FOLDER, "documents")
    same(interpolation.score_texts(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(interpolation, "PACK_BYTES", 1000)
    same(interpolation.score_texts(clashing(spark)).collect(), brute([(r[0], r[1]) for r in documents()]))


def test_parts_follow_the_checksum():
    for doc in [0, 1, 17, 123456789]:
        assert (interpolation.part_of(doc) == interpolation.HELD_OUT) == (zlib.crc32(str(doc).encode()) % 5 == 1)


def test_held_out_texts_score_above_the_base(spark):
    rows = interpolation.score_texts(table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_mixture_prefers_what_predicts():
    cells = pd.DataFrame({"bucket": [3, 3], "high": [-1, -2], "low": [-40, -36], "n": [900, 100]})
    weights = interpolation.learn_mixture(cells, 1e-4)
    assert weights[3, 0] > 0.9 and np.allclose(weights.sum(axis=1), 1)


def test_numbers_survive_packing():
    for values in [np.array([], "<u8"), np.array([0, 1 << 63, 5], "<u8"), np.arange(1000, dtype="<u4")]:
        assert (interpolation.expand(interpolation.shrink(values), values.dtype.str) == values).all()


def test_nothing_to_learn_from(spark):
    assert interpolation.score_texts(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    [r] = interpolation.score_texts(frame(spark, [(held, "a b", None, None, 3)])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
