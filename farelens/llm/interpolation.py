"""Language-model scores by deleted interpolation.

A bigram model over words: each estimate is a mix of the bigram's and the word's maximum-likelihood
estimates and a uniform share. The mixture depends on how often the context was seen, in buckets of
powers of two, and is learned by expectation-maximisation on counts of a part of the training texts
that is deleted from the counts that are mixed (every fourth of them). Scores then use the counts of
all training texts.

The number of n-grams grows with the corpus, so no table of them is broadcast or gathered. Texts are
put up in packs of some MB. Each pack asks each shard of the key space for the counts of the distinct
n-grams it has there: one row of sorted keys, with its own counts if it is a training pack. A shard
adds up what all packs tell and answers in the order it was asked. The answers meet their pack again
to score it. A frequent n-gram is asked for once per pack, so no key is hot, and a shard's size is
set by the number of shards, which follows the corpus.

What goes through the driver are totals, and the deleted counts as a histogram over buckets and
quarter octaves of both estimates, whose size does not depend on the corpus.

Defined cases: a null text counts as empty and has its end alone; equal texts get equal scores;
without training texts every token has probability 1; a null id is checked as an empty one;
an empty table gives an empty result; other input columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from farelens.llm.common import store

KEPT, DELETED, HELD_OUT = 0, 1, 2
PACK_BYTES = 8_000_000
PACK_CODEC = pa.Codec("zstd", compression_level=6)  # packs are stored once and shuffled once
SHARD_TOKENS = 1_500_000
BUCKETS = 48
STEPS_PER_OCTAVE = 4
NEVER = -1000
START = np.uint64(0x9E3779B97F4A7C15)  # a context before the first token, not a token
END = np.uint64(0xD1B54A32D192ED03)  # the token after the last word
PACK_SCHEMA = "pack long, part int, n_tokens long, texts binary"
ASK_SCHEMA = "shard long, pack long, part int, gram int, keys binary, counts binary"
ANSWER_SCHEMA = "pack long, gram int, shard long, trained binary, kept binary, n_types long, n_trained long, n_kept long"
CELL_SCHEMA = "bucket int, high int, low int, n long"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def part_of(doc_id) -> int:
    """Held out from training, deleted from the counts that are mixed, or kept in them."""
    r = zlib.crc32(("" if pd.isna(doc_id) else str(int(doc_id))).encode()) % 5
    return HELD_OUT if r == 1 else DELETED if r == 3 else KEPT


def shrink(values: np.ndarray) -> bytes:
    """Numbers with equal bytes side by side, compressed."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def expand(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def pack_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to packs of one part each."""
    held: dict[int, tuple[list, list]] = {KEPT: ([], []), DELETED: ([], []), HELD_OUT: ([], [])}
    sizes = dict.fromkeys(held, 0)
    lane, made = TaskContext.get().partitionId(), 0

    def flush(part: int) -> pd.DataFrame:
        nonlocal made
        ids, texts = held[part]
        batch = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=PACK_CODEC)) as writer:
            writer.write_batch(batch)
        tokens = sum(len(t.encode().split()) + 1 for t in texts)
        row = ((lane << 32) + made, part, tokens, sink.getvalue().to_pybytes())
        held[part], sizes[part], made = ([], []), 0, made + 1
        return pd.DataFrame([row], columns=["pack", "part", "n_tokens", "texts"])

    for docs in batches:
        for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
            text, part = text or "", part_of(doc)
            held[part][0].append(None if pd.isna(doc) else int(doc))
            held[part][1].append(text)
            sizes[part] += len(text) + 64
            if sizes[part] >= PACK_BYTES:
                yield flush(part)
    for part in held:
        if held[part][0]:
            yield flush(part)


@dataclass
class Grams:
    """Tokens of a pack: word keys with a start before each text, bigram keys, and where texts begin."""

    doc_ids: list
    words: np.ndarray
    is_token: np.ndarray
    pairs: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray


def grams_of(packed: bytes) -> Grams:
    batch = pa.ipc.open_stream(packed).read_all()
    key, runs = xxhash.xxh3_64_intdigest, []
    lengths = np.empty(batch.num_rows, np.int64)
    for i, text in enumerate(batch["text"]):
        words = text.as_py().encode().lower().split()
        run = np.empty(len(words) + 2, np.uint64)
        run[0], run[-1] = START, END
        run[1:-1] = np.fromiter(map(key, words), np.uint64, len(words))
        runs.append(run)
        lengths[i] = len(words) + 1
    words = np.concatenate(runs)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))  # in tokens
    is_token = np.ones(len(words), bool)
    is_token[begins + np.arange(len(begins))] = False
    before = words[np.flatnonzero(is_token) - 1]
    pairs = before * np.uint64(0x9FB21C651E98DF25) + words[is_token] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(32)
    pairs *= np.uint64(0xD6E8FEB86659FD93)
    pairs ^= pairs >> np.uint64(32)
    return Grams(batch["doc_id"].to_pylist(), words, is_token, pairs, begins, lengths)


def asking(shard_bits: int):
    """Packs to questions: sorted distinct keys and their own counts, by shard."""
    shift = np.uint64(64 - shard_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for packs in batches:
            for pack, part, texts in zip(packs["pack"], packs["part"], packs["texts"], strict=True):
                grams, rows = grams_of(texts), []
                for gram, keys in ((1, grams.words), (2, grams.pairs)):
                    keys, counts = np.unique(keys, return_counts=True)
                    shards = (keys >> shift).astype(np.int64) if shard_bits else np.zeros(len(keys), np.int64)
                    edges = np.flatnonzero(np.diff(shards, prepend=-1, append=1 << 62))
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        steps = np.diff(keys[a:b], prepend=np.uint64(0))
                        own = None if part == HELD_OUT else shrink(counts[a:b].astype("<u4"))
                        rows.append((int(shards[a]), pack, part, gram, shrink(steps), own))
                yield pd.DataFrame(rows, columns=["shard", "pack", "part", "gram", "keys", "counts"])

    return run


def answer(questions: pd.DataFrame) -> pd.DataFrame:
    """One shard and n-gram length: adds up and answers each pack in the order of its keys."""
    asked = [np.cumsum(expand(k, "<u8"), dtype=np.uint64) for k in questions["keys"]]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    trained, kept = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    ends = np.cumsum([len(a) for a in asked])
    spans = [place[e - len(a) : e] for a, e in zip(asked, ends, strict=True)]
    for span, part, counts in zip(spans, questions["part"], questions["counts"], strict=True):
        if part != HELD_OUT:
            own = expand(counts, "<u4").astype(np.int64)
            trained[span] += own  # a pack's keys are distinct
            if part == KEPT:
                kept[span] += own
    gram, shard = int(questions["gram"].iloc[0]), int(questions["shard"].iloc[0])
    token = keys != START if gram == 1 else np.ones(len(keys), bool)
    totals = (int((trained[token] > 0).sum()), int(trained[token].sum()), int(kept[token].sum()))
    rows = [(None, gram, shard, None, None, *totals)]
    for pack, part, span in zip(questions["pack"], questions["part"], spans, strict=True):
        deleted = shrink(kept[span].astype("<u4")) if part == DELETED else None
        rows.append((pack, gram, shard, shrink(trained[span].astype("<u4")), deleted, None, None, None))
    names = [c.split()[0] for c in ANSWER_SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=names).astype(
        {"pack": "Int64", "n_types": "Int64", "n_trained": "Int64", "n_kept": "Int64"}
    )


@dataclass
class Counts:
    pair: np.ndarray
    context: np.ndarray
    word: np.ndarray


def counts_of(grams: Grams, answers: pd.DataFrame, column: str) -> Counts:
    """Counts of each token, its context and both together."""
    by_gram = []
    for gram, keys in ((1, grams.words), (2, grams.pairs)):
        told = answers[answers["gram"] == gram].sort_values("shard")
        counts = np.concatenate([expand(b, "<u4") for b in told[column]]).astype(np.float64)
        by_gram.append(counts[np.unique(keys, return_inverse=True)[1]])
    words, pairs = by_gram
    at = np.flatnonzero(grams.is_token)
    return Counts(pairs, words[at - 1], words[at])


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the power of two below the count."""
    power = np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1
    return np.where(context > 0, np.minimum(power, BUCKETS - 1), 0)


def deleted_cells(n_kept: int):
    """Tokens of a deleted pack by bucket and rounded estimates."""

    def run(_key, packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "high", "low", "n"]
        if packs.empty:
            return pd.DataFrame(columns=names)
        grams = grams_of(packs["texts"].iloc[0])
        c = counts_of(grams, answers, "kept")
        rounded = lambda p: np.where(
            p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * STEPS_PER_OCTAVE), NEVER
        ).astype(np.int64)
        high = rounded(c.pair / np.maximum(c.context, 1))
        low = rounded(c.word / max(n_kept, 1))
        cells, n = np.unique(np.stack([bucket_of(c.context), high, low]), axis=1, return_counts=True)
        return pd.DataFrame({"bucket": cells[0], "high": cells[1], "low": cells[2], "n": n})

    return run


def learn_mixture(cells: pd.DataFrame, uniform: float, rounds: int = 200) -> np.ndarray:
    """Weights of bigram, word and uniform estimate by bucket, by expectation-maximisation."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = (0.0, 0.9, 0.1)
    value = lambda q: np.where(q > NEVER, 2.0 ** (q / STEPS_PER_OCTAVE), 0.0)
    for bucket, rows in cells.groupby("bucket"):
        estimates = np.stack(
            [value(rows["high"].to_numpy()), value(rows["low"].to_numpy()), np.full(len(rows), uniform)], axis=1
        )
        n, w = rows["n"].to_numpy(float), weights[int(bucket)]
        for _ in range(rounds):
            joint = estimates * w
            share = joint / joint.sum(axis=1, keepdims=True)
            new = (n[:, None] * share).sum(axis=0) + 0.01 * (weights[int(bucket)] > 0)
            new /= new.sum()
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-7:
                break
        weights[int(bucket)] = w
    return weights


def scoring(weights: np.ndarray, n_types: int, n_trained: int):
    """Scores of a pack's texts."""

    def run(_key, packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]
        if packs.empty:
            return pd.DataFrame(columns=names)
        grams = grams_of(packs["texts"].iloc[0])
        c = counts_of(grams, answers, "trained")
        w = weights[bucket_of(c.context)]
        uniform = 1 / (n_types + 1)
        if n_trained:
            p = w[:, 0] * c.pair / np.maximum(c.context, 1) + w[:, 1] * c.word / n_trained + w[:, 2] * uniform
        else:
            p = np.full(len(c.word), uniform)
        base = (c.word + 0.5) / (n_trained + 0.5 * (n_types + 1))
        add = lambda values: np.add.reduceat(values, grams.begins)
        return pd.DataFrame(
            {
                "doc_id": pd.array(grams.doc_ids, "Int64"),
                "held_out": bool(packs["part"].iloc[0] == HELD_OUT),
                "n_tokens": grams.lengths,
                "n_known": add((c.word > 0).astype(np.int64)),
                "train_tokens": n_trained,
                "base_score": add(np.log10(base)),
                "score": add(np.log10(p)),
            }
        )[names]

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of all documents (doc_id, text) by a model of those that are not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packs = store(texts.mapInPandas(pack_texts, PACK_SCHEMA), "packs")
    tokens = packs.agg(F.sum("n_tokens")).first()[0] or 0
    shard_bits = max(0, int(np.ceil(np.log2(max(tokens, 1) / SHARD_TOKENS))))

    questions = packs.mapInPandas(asking(shard_bits), ASK_SCHEMA)
    answers = store(questions.groupBy("shard", "gram").applyInPandas(answer, ANSWER_SCHEMA), "answers")
    total = answers.filter("pack IS NULL AND gram = 1").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_types", "n_trained", "n_kept")]
    ).first()
    told = answers.filter("pack IS NOT NULL").select("pack", "gram", "shard", "trained", "kept")

    deleted = packs.filter(F.col("part") == DELETED)
    cells = (
        deleted.groupBy("pack")
        .cogroup(told.filter("kept IS NOT NULL").drop("trained").groupBy("pack"))
        .applyInPandas(deleted_cells(total.n_kept), CELL_SCHEMA)
        .groupBy("bucket", "high", "low")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    weights = learn_mixture(cells, 1 / (total.n_types + 1))
    return (
        packs.groupBy("pack")
        .cogroup(told.drop("kept").groupBy("pack"))
        .applyInPandas(scoring(weights, total.n_types, total.n_trained), SCORE_SCHEMA)
    )
