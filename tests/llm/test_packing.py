import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import FOLDER
from frames import clashing, documents, empty, frame
from tokenizers import Tokenizer

from farelens.llm import packing
from farelens.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
CODER = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*CODER.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def check(rows, pieces, width=packing.WIDTH):
    """Each id in exactly one piece, with the right checksum; sequences without gaps."""
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(ids_of(text))
    found, expected = defaultdict(Counter), defaultdict(Counter)
    for p in pieces:
        found[p.doc_id][p.doc_tokens] += p.length
        assert any(
            len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
            for ids in texts[p.doc_id]
        )
        assert 0 < p.length and p.start + p.length <= p.doc_tokens
    for doc, many in texts.items():
        for ids in many:
            expected[doc][len(ids)] += len(ids)
    assert found == expected
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return sum(p.length for p in pieces) / max(len(sequences) * width, 1)


def test_table(spark):
    docs = table(spark, FOLDER, "documents")
    share = check([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, PATH).collect())
    assert share > 0.95


@pytest.mark.parametrize("width", [4096, 64])
def test_awkward_rows(spark, width):
    rows = documents()
    pieces = packing.pack(clashing(spark, rows), PATH, width=width).collect()
    check([(r[0], r[1]) for r in rows], pieces, width)


def test_many_texts_of_one_length(spark):
    rows = [(i, "the cat " * 700, None, None, 0) for i in range(60)]
    share = check([(r[0], r[1]) for r in rows], packing.pack(frame(spark, rows), PATH).collect())
    assert share > 0.95


def test_empty_table(spark):
    assert packing.pack(empty(spark), PATH).count() == 0


def test_words_are_coded_as_whole_texts_are():
    odd = [
        "á ́b  <|endoftext|>x <|startoftext|> it's\x1cq\x85z\u3000w Σας ﬁ", "'s 't", "\x1c", "I'LL DON'T", "",
        "e\u0301\u2000 \u0327c", "a\u2028b\u00a0c", "x" * 3000, "\U0001f600 \U0001f600\u200d", "12 345 ６７",
        "don't I'LLx'sy''s 's's \"''re a'd1'm ÀÈÌ-é1é STRASSE straße ÷ × µ ª º ÿŸ", "<|x|> a<|b <| endoftext|>",
    ]
    odd += [r[1] or "" for r in documents()]
    encode = packing.WordCoder(PATH).encode
    for text in odd:
        assert encode(text).tolist() == ids_of(text)[:-1].tolist()

    every = "".join(chr(c) for c in range(33, 256))
    for a in every:  # all pairs of characters of the first two code pages, as words of their own
        pairs = " ".join(a + b for b in every)
        assert encode(pairs).tolist() == ids_of(pairs)[:-1].tolist()


def test_every_piece_of_the_vocabulary():
    coder = packing.WordCoder(PATH)
    assert coder.ranked is not None
    shown = packing.byte_alphabet()
    for token in CODER.get_vocab():
        word = bytes(shown.get(c, 0) for c in token.removesuffix("</w>")).decode(errors="ignore")
        assert coder.encode(word).tolist() == ids_of(word)[:-1].tolist()
        assert coder.encode(word + word[::-1] + "qz").tolist() == ids_of(word + word[::-1] + "qz")[:-1].tolist()


def test_another_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    coder = packing.WordCoder(path)
    assert coder.ranked is None
    texts = ["Hello World, it's 42", "", None, "  two  spaces\n", "漢字 <|endoftext|>"]
    for text in texts:
        assert coder.encode(text or "").tolist() == other.encode(text or "", add_special_tokens=False).ids
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    sizes = {p.doc_id: p.doc_tokens for p in packing.pack(frame(spark, rows), path).collect()}
    assert sizes == {i: 1 + len(coder.encode(t or "")) for i, t in enumerate(texts)}


def test_ids_beyond_doubles(spark):
    rows = [(2**53 + 1, "one", None, None, 0), (None, "one", None, None, 0)]
    assert {p.doc_id for p in packing.pack(frame(spark, rows), PATH).collect()} == {2**53 + 1, None}


def test_combinations():
    every = packing.combinations(8, set(range(1, 9)), 3)
    assert sorted(every) == sorted({t for a in range(1, 9) for b in range(a + 1) for c in range(b + 1)
                                    for t in [tuple(x for x in (a, b, c) if x)] if sum(t) == 8})


def test_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.random(12) * 10
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient < 1e-4).all() and (np.abs(gradient[x > 0]) < 1e-4).all()


def test_no_class_is_used_more_often_than_it_occurs():
    histogram = {1: 5, 3: 7, 5: 9, 7: 2, 8: 4}
    used = Counter()
    for classes, times in packing.repeat_counts(histogram, 8):
        for c in classes:
            used[c] += times
    assert all(used[c] <= n for c, n in histogram.items()) and used[8] == 4
    assert packing.repeat_counts({}, 8) == []
