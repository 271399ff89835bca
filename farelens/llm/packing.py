"""Packing token sequences by non-negative least squares.

A document's ids, closed by an end id, are cut into full windows and a rest. Rests are counted by
length class (``STEP`` ids wide). Shallow combinations of classes that fill a window are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares, rounded down and
topped up as far as the histogram allows. What is left over is laid end to end and cut at window
edges, so only the very last sequence can be far from full.

Only the histogram (as many rows as there are classes) goes through the driver. Ranks within a class
are counted where the texts are read, and shifted by the counts of the lanes (tasks) before; no class
is ever gathered. Ids are stored once in the shared scratch folder; after that only those of documents
that an edge cuts are read again.

Defined cases: a null text counts as empty and gives the end id alone; equal rows are packed as
often as they occur; a text of any length is cut into windows; an empty table gives no pieces; other
input columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from farelens.llm.common import byte_alphabet, store

WIDTH = 4096
STEP = 16
DEPTH = 3
END_ID = 2
# Characters of texts whose ids a task holds before it hands them on.
HELD_CHARS = 8_000_000
# How the word tokenizer prepares and splits text, and the same split for text that is
# in lower case and of these characters (ASCII and accented Latin letters).
WORD_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORD_SPLIT = [
    {
        "type": "Split",
        "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
WORD_END = "</w>"
SPACES = re.compile("[ \t-\r]+")
PLAIN = re.compile("[ \t-\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PLAIN_PIECE = re.compile(
    "[a-z\u00df-\u00f6\u00f8-\u00ff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \t-\ra-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
)
# Stands for the end of a word where ranks go by bytes; no plain text has it.
MARK = "\x01"
STORED = "row_id long, lane long, doc_id string, doc_tokens long, full_crcs array<long>, full_before long, rest int, class int, rank long, rest_crc long, rest_ids binary"
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class WordCoder:
    """Encodes texts as the tokenizer does, without special tokens of its own.

    Plain words of the word tokenizer are split here and merged by ``tiktoken``, to which the end of a
    word is one more byte; all else, and every text of any other tokenizer, goes to the tokenizer whole.
    Nothing is kept from text to text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.ranked = word_ranks(json.load(file))

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None:
            return self.by_tokenizer(text)
        if is_plain(text):
            return self.by_ranks(text)
        runs = groupby(SPACES.split(text), is_plain)
        parts = [(self.by_ranks if plain else self.by_tokenizer)(" ".join(words)) for plain, words in runs]
        return np.concatenate(parts)

    def by_ranks(self, text: str) -> np.ndarray:
        pieces = PLAIN_PIECE.findall(text.lower())
        if not pieces:
            return np.empty(0, "<u4")
        pieces.append("")
        return np.array(self.ranked.encode_ordinary(MARK.join(pieces)), "<u4")

    def by_tokenizer(self, text: str) -> np.ndarray:
        (coded,) = self.coder.encode_batch_fast([text], add_special_tokens=False)
        return np.array(coded.ids, "<u4")


def is_plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None and "<|" not in text


def word_ranks(settings: dict):
    """The word tokenizer's merges by rank, or None for a tokenizer that prepares or merges otherwise."""
    model = settings["model"]
    normalizer, split = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    as_assumed = (
        model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == WORD_END
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and normalizer.get("normalizers") == WORD_NORMALIZER
        and split.get("pretokenizers") == WORD_SPLIT
        and all(t["content"].startswith("<|") for t in settings.get("added_tokens", ()))
    )
    if not as_assumed:
        return None
    vocabulary, alphabet = model["vocab"], byte_alphabet()
    special = {t["content"] for t in settings.get("added_tokens", ())}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocabulary["".join(p)] for p in pairs]
    ranks: dict[bytes, int] = {}
    for token, i in vocabulary.items():
        if token not in special:
            word = token.removesuffix(WORD_END)
            ranks[bytes(alphabet[c] for c in word) + (MARK.encode() if word != token else b"")] = i
    ends = [ranks.get(bytes([b]) + MARK.encode(), len(vocabulary)) for b in range(256)]
    # Ids in the order of the merges, ends of words before all merges, and no two tokens with the same bytes.
    if merged != sorted(set(merged)) or max(ends) >= merged[0] or len(ranks) != len(vocabulary.keys() - special):
        return None
    import tiktoken

    return tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def coded(path: str, end_id: int, width: int, step: int):
    """Batches of texts to rows of ``STORED``; ranks and full windows are counted per task."""

    columns = [c.split()[0] for c in STORED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_coder(path).encode
        lane = TaskContext.get().partitionId()
        ranks, rows_before, full_before, rows, held = Counter(), 0, 0, [], 0
        for docs in batches:
            for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                n_full, rest = divmod(len(ids), width)
                crcs = [zlib.crc32(ids[i * width : (i + 1) * width].tobytes()) for i in range(n_full)]
                tail = ids[n_full * width :]
                kind = -(-rest // step)
                rows.append(
                    (
                        (lane << 40) + rows_before, lane, doc, len(ids), crcs, full_before, rest, kind, ranks[kind],
                        zlib.crc32(tail.tobytes()), tail.tobytes(),
                    )
                )
                rows_before, full_before = rows_before + 1, full_before + n_full
                ranks[kind] += 1
                held += len(text or "")
                if held > HELD_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return run


def combinations(classes: int, present: set[int], depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Descending tuples of up to ``depth`` present classes that add up to ``classes``."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < depth:
            top = min(left, head[-1] if head else left)
            least = -(-left // (depth - len(head)))
            for c in range(least, top + 1):
                if c in present:
                    extend((*head, c), left - c)

    extend((), classes)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The x >= 0 that brings ``a @ x`` nearest to ``b``, by an active set."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient)) if n else 0
        if n == 0 or gradient[best] <= 1e-6 * max(1.0, b.max()):
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            part = a[:, columns]
            gram = part.T @ part + 1e-9 * np.eye(len(columns))
            solved = np.linalg.solve(gram, part.T @ b)
            if (solved > 0).all():
                x[:] = 0
                x[columns] = solved
                break
            at = x[columns]
            falling = solved <= 0
            ratio = at[falling] / np.maximum(at[falling] - solved[falling], 1e-30)
            x[columns] = at + ratio.min() * (solved - at)
            active[columns[falling & (x[columns] <= 1e-12)]] = False
            active[columns[falling][int(np.argmin(ratio))]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def repeat_counts(histogram: dict[int, int], classes: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used; no class is used more often than it occurs."""
    tuples = combinations(classes, {c for c, n in histogram.items() if n > 0 and c > 0}, depth)
    if not tuples:
        return []
    a = np.zeros((classes + 1, len(tuples)))
    for j, t in enumerate(tuples):
        for c in t:
            a[c, j] += 1
    b = np.zeros(classes + 1)
    for c, n in histogram.items():
        b[c] = n
    fitted = nnls(a, b)
    left, used = Counter({c: int(n) for c, n in histogram.items()}), Counter()
    by_use = sorted(range(len(tuples)), key=lambda j: (-fitted[j], tuples[j]))
    for limit in (lambda j: int(fitted[j]), lambda j: left.total()):
        for j in by_use:
            need = Counter(tuples[j])
            times = min(limit(j), *(left[c] // m for c, m in need.items()))
            if times > 0:
                used[j] += times
                for c, m in need.items():
                    left[c] -= m * times
    return [(tuples[j], n) for j, n in sorted(used.items())]


def slots(counts: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, slot): who goes where."""
    taken, first, out = Counter(), 0, []
    for classes, times in counts:
        for slot, c in enumerate(classes):
            out.append((c, taken[c], taken[c] + times, first, slot))
            taken[c] += times
        first += times
    return out


def cut_crcs(ids: pd.Series, head: pd.Series) -> pd.DataFrame:
    """Checksums of what lies before and behind ``head`` ids."""
    pairs = [(zlib.crc32(b[: 4 * h]), zlib.crc32(b[4 * h :])) for b, h in zip(ids, head, strict=True)]
    return pd.DataFrame(pairs, columns=["head", "tail"], dtype="int64")


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, width: int = WIDTH, step: int = STEP, depth: int = DEPTH
) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their places in sequences of ``width``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a long with nulls would be a double there
    stored = store(texts.mapInPandas(coded(tokenizer, end_id, width, step), STORED), "tokens")
    stored = stored.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stored.drop("rest_ids")

    lanes = rows.groupBy("lane", "class").agg(F.count("*").alias("n"))
    full_lanes = rows.groupBy("lane").agg(F.sum(F.size("full_crcs")).alias("n")).select(
        "lane", F.lit(-1).alias("class"), "n"
    )
    before = Window.partitionBy("class").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    shifted = store(
        lanes.unionByName(full_lanes).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")),
        "lanes",
    )
    totals = {r["class"]: r.n for r in shifted.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    n_full = totals.pop(-1, 0) or 0
    counts = repeat_counts({c: n for c, n in totals.items() if c > 0}, width // step, depth)
    n_combined = sum(times for _, times in counts)

    full = (
        rows.filter(F.size("full_crcs") > 0)
        .join(shifted.filter("class = -1").select("lane", "shift"), "lane")
        .select("doc_id", "doc_tokens", F.col("shift").alias("first"), "full_before", F.posexplode("full_crcs").alias("i", "crc"))
        .select(
            "doc_id", (F.col("i").cast("long") * width).alias("start"), F.lit(width).cast("long").alias("length"),
            F.col("crc").alias("ids_crc32"), "doc_tokens",
            (F.col("first") + F.col("full_before") + F.col("i")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )

    start = (F.col("doc_tokens") - F.col("rest")).alias("start")
    ranked = (
        rows.filter("rest > 0")
        .join(shifted.filter("class > 0").select("lane", "class", "shift"), ["lane", "class"])
        .select(
            "row_id", "lane", "class", "doc_id", "doc_tokens", start, F.col("rest").cast("long").alias("length"),
            F.col("rest_crc").alias("ids_crc32"), (F.col("shift") + F.col("rank")).alias("rank"),
        )
    )
    places = spark.createDataFrame(
        slots(counts), "__class int, __from long, __to long, __first long, __slot int"
    )  # at most as many combinations as classes by least squares, and as many more by topping up
    placed = store(
        ranked.join(
            F.broadcast(places),
            (F.col("class") == F.col("__class")) & (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__to")),
            "left",
        ),
        "places",
    )
    in_sequence = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    combined = (
        placed.filter("__class is not null")
        .withColumn("sequence_id", F.lit(n_full) + F.col("__first") + F.col("rank") - F.col("__from"))
        .withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)))
        .select(*PIECE)
    )

    left = placed.filter("__class is null")
    lane_sums = left.groupBy("class", "lane").agg(F.sum("length").alias("n"))
    running = store(lane_sums.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")), "residuals")
    class_sums = {r["class"]: r.n for r in running.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    firsts, at = [], 0
    for c in sorted(class_sums, reverse=True):
        firsts.append((c, at))
        at += class_sums[c]
    bases = F.broadcast(spark.createDataFrame(firsts, "class int, base long"))
    in_lane = Window.partitionBy("class", "lane").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        left.join(running.select("class", "lane", "at"), ["class", "lane"])
        .join(bases, "class")
        .withColumn("pos", F.col("base") + F.col("at") + F.coalesce(F.sum("length").over(in_lane), F.lit(0)))
        .withColumn("head", F.least(F.col("length"), F.lit(width) - F.col("pos") % width))
    )
    laid = store(laid.select("row_id", *PIECE[:5], "pos", "head"), "laid")
    sequence = F.lit(n_full + n_combined) + F.floor(F.col("pos") / width)
    uncut = laid.filter("head = length").select(
        *PIECE[:5], sequence.alias("sequence_id"), (F.col("pos") % width).alias("offset")
    )
    crcs = laid.filter("head < length").join(stored.select("row_id", "rest_ids"), "row_id").withColumn(
        "crc", F.pandas_udf(cut_crcs, "head long, tail long")("rest_ids", "head")
    )
    parts = F.array(
        F.struct(
            F.col("start"), F.col("head").alias("length"), F.col("crc.head").alias("ids_crc32"),
            sequence.alias("sequence_id"), (F.col("pos") % width).alias("offset"),
        ),
        F.struct(
            (F.col("start") + F.col("head")).alias("start"), (F.col("length") - F.col("head")).alias("length"),
            F.col("crc.tail").alias("ids_crc32"), (sequence + 1).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        ),
    )
    cut = crcs.select("doc_id", "doc_tokens", F.explode(parts).alias("p")).select("doc_id", "doc_tokens", "p.*")
    out = full.unionByName(combined).unionByName(uncut.select(*PIECE)).unionByName(cut.select(*PIECE))
    return out.select(*[F.col(c).cast("long").alias(c) for c in PIECE])
