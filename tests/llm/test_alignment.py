import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import FOLDER
from frames import clashing, documents, empty, frame
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from __spark_entry__ import queries
from farelens.llm import token_alignment
from farelens.llm.common import byte_alphabet, table

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
CODER, MODEL = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
CODER.encode_special_tokens = True
ALPHABET = byte_alphabet()
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(text):
    """(id, bytes) lists of both tokenizers, straight from the libraries; empty without a common text."""
    if not text:
        return [], []
    a = [(i, bytes(ALPHABET[c] for c in CODER.id_to_token(i))) for i in CODER.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in MODEL.encode(text):
        piece = MODEL.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if MODEL.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = whole == b"".join(x for _, x in a) == b"".join(x for _, x in b)
    return (a, b) if same else ([], [])


def brute(rows):
    """The contract's rows by walking through both token lists, one token at a time."""
    per_row, corpus = [], Counter()
    for doc, text in rows:
        a, b = tokens(text)
        links, groups, i, j, a_end, b_end, open_a, open_b = [], [], 0, 0, 0, 0, [], []
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            left, right = a_end + len(a[i][1]), b_end + len(b[j][1])
            if left <= right:
                open_a.append(str(a[i][0]))
                i, a_end = i + 1, left
            if right <= left:
                open_b.append(str(b[j][0]))
                j, b_end = j + 1, right
            if left == right:
                groups.append(",".join(open_a) + "|" + ",".join(open_b))
                open_a, open_b = [], []
        corpus.update(links)
        per_row.append((doc, len(a), len(b), groups, links))
    best = {}
    for (_, b), n in corpus.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc, n_a, n_b, groups, links in per_row:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        n_best = sum(corpus[link] == best[link[1]] for link in links)
        out.append((doc, n_a, n_b, len(groups), len(links), n_best, sum(corpus[x] for x in links), digest))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table(spark):
    docs = table(spark, FOLDER, "documents")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = queries()["op11_alignment"](spark, FOLDER)
    assert set(COLUMNS) <= set(got.columns) and rows_of(got) == expected


ODD = [
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", " leading", "tab\tnew\nline \n\n  x", "漢字かな交じり文 😀👩‍👩‍👧 ﬁ Ⅷ",
    "ünïcode " * 300, "Donaudampfschifffahrtsgesellschaftskapitän " * 50, "\u0000\u0001", "   ", "é ​﻿",
]


@pytest.mark.parametrize(("width", "most"), [(32_768, 500_000), (7, 50), (1, 0), (64, 3)])
def test_pieces_of_any_width(spark, width, most):
    rows = [(i, t, None, None, 0) for i, t in enumerate([*ODD, *ODD[4:7]])] + documents()[:8]
    got = token_alignment.align(frame(spark, rows), A, B, width, most)
    assert rows_of(got) == brute([(r[0], r[1]) for r in rows])


def test_awkward_rows_and_clashing_columns(spark):
    rows = documents()
    got = token_alignment.align(clashing(spark, rows), A, B, width=5000)
    assert rows_of(got) == brute([(r[0], r[1]) for r in rows])


def test_ids_beyond_doubles(spark):
    rows = [(2**53 + 1, "one", None, None, 0), (None, "one", None, None, 0)]
    assert {r.doc_id for r in token_alignment.align(frame(spark, rows), A, B).collect()} == {2**53 + 1, None}


def test_diagonals_divide_the_merge_equally():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(1, 400, rng.integers(1, 200))) for _ in "ab")
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for width in (1, 3, 50, 1000):
            at_a, at_b = token_alignment.diagonal_cuts(a, b, width)
            for i, j in zip(at_a, at_b, strict=True):
                first = merged[: i + j]
                assert sum(s == 0 for _, s in first) == i and (i + j) in (*range(0, len(merged), width), len(merged))


def test_slow_and_fast_encoders_agree():
    coder = token_alignment.ByteLevel(A)
    assert coder.fast is not None
    texts = [*ODD, *[r[1] for r in documents() if r[1]]]
    expected = [CODER.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [coder.encode(t).tolist() for t in texts] == expected
    coder.fast, coder.coder = None, CODER
    assert [coder.encode(t).tolist() for t in texts] == expected


def test_empty_table(spark):
    assert token_alignment.align(empty(spark), A, B).count() == 0
