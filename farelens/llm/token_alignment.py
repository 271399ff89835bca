"""Alignment of two tokenizers by merge-path partitioning.

A text is encoded by tokenizers A and B. Both cut the same bytes, so aligning them is merging two
ascending lists of token ends. Binary searches along diagonals of that merge (``width`` steps apart)
divide it into pieces of equal work, each of which knows where it begins in both lists. A piece is a
row of its own, with one token more on either side; it emits its overlaps (links) and the groups that
lie wholly in it without looking at any other piece. Of texts with several pieces, the groups that
piece edges cut are stitched afterwards; the many texts with one piece need no shuffle.

How often a pair of ids is linked in the corpus is counted per task, then per pair. The ``most``
commonest pairs, and the highest count of each B id, are bounded tables and go to all tasks, where
they answer nearly every link; links of rarer pairs are joined with the counts, where no key is hot.

Encoding is the only step that needs a whole text. Pieces, counts and what pieces found are stored
in the shared scratch folder, so that a lost executor costs its own tasks only.

Defined cases: texts that are null or empty, or whose joined token bytes differ from a space and the
text, have no tokens, zeros, and an empty ``groups_sha256``; the tokenizers' special strings within a
text are plain text; texts of any length are encoded whole; equal rows are counted as often as they
occur; an empty table gives an empty one; other input columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from farelens.llm.common import byte_alphabet, store

WIDTH = 32_768
MOST_PAIRS = 500_000
HELD_KEYS = 2_000_000
HELD_CHARS = 500_000
SPACE_MARK = "▁"

PIECES = (
    "row_id long, doc_id string, piece int, pieces int, a_at long, b_at long, n_a int, n_b int,"
    " a_ids binary, b_ids binary"
)
FOUND = (
    "row_id long, doc_id string, piece int, pieces int, n_a long, n_b long, n_groups long, n_links long,"
    " n_best long, count_sum long, groups_sha256 string, lead_a string, lead_b string, body string,"
    " tail_a string, tail_b string, rare array<struct<pair:long,n:long>>"
)


def named(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class ByteLevel:
    """Tokenizer A: byte-level BPE of a ``tokenizers`` file, special strings being plain text.

    Where the file is a plain rank vocabulary (ids in the order of the merges, the usual split), its
    ranks are given to the faster ``tiktoken``; any other file is used as it is.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        special = {t["id"] for t in settings.get("added_tokens", ())}
        alphabet = byte_alphabet()
        vocabulary = settings["model"]["vocab"]
        self.bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            known = i not in special and all(c in alphabet for c in token)
            self.bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        self.fast = self._ranked(settings, ranks)
        if self.fast is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
            from tokenizers import Tokenizer

            self.coder = Tokenizer.from_file(path)
            self.coder.encode_special_tokens = True

    @staticmethod
    def _ranked(settings: dict, ranks: dict[bytes, int]):
        model, split = settings["model"], settings.get("pre_tokenizer") or {}
        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        merged = [vocabulary["".join(p)] for p in pairs]
        plain = (
            model.get("type") == "BPE"
            and not settings.get("normalizer")
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(a < b for a, b in zip(merged, merged[1:], strict=False))
            and len(ranks) == len(merged) + 256
        )
        if not plain:
            return None
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.coder.encode(" " + text, add_special_tokens=False).ids, "<u4")


class Pieces:
    """Tokenizer B: a ``sentencepiece`` model, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.coder = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(i)
            is_byte = self.coder.is_byte(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(SPACE_MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def coders(path_a: str, path_b: str) -> tuple[ByteLevel, np.ndarray, Pieces, np.ndarray]:
    """Both tokenizers, and the bytes of each of their ids."""
    a, b = ByteLevel(path_a), Pieces(path_b)
    return a, np.array([len(x) for x in a.bytes], "<u4"), b, np.array([len(x) for x in b.bytes], "<u4")


def id_type(sizes: np.ndarray) -> str:
    """The type in which ids of a vocabulary are stored."""
    return "<u2" if len(sizes) <= 1 << 16 else "<u4"


def diagonal_cuts(a_ends: np.ndarray, b_ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A and of B are among the first 0, width, 2 width, ... merged ends, A before B in ties.

    One binary search a diagonal, all at once: the least i with a_ends[i] > b_ends[d - i - 1].
    """
    n_a, n_b = len(a_ends), len(b_ends)
    d = np.append(np.arange(0, n_a + n_b, width), n_a + n_b)
    low, high = np.maximum(d - n_b, 0), np.minimum(d, n_a)
    while (open_ := low < high).any():
        i = (low + high) // 2
        a = a_ends[np.minimum(i, n_a - 1)]
        b = b_ends[np.clip(d - i - 1, 0, n_b - 1)]
        further = open_ & (a <= b)
        low, high = np.where(further, i + 1, low), np.where(open_ & ~further, i, high)
    return low, d - low


def joined_bytes(parts: list[bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(parts.__getitem__, ids))


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """(doc_id, text) rows, in lists of at most ``HELD_CHARS`` characters or one text."""
    held, chars = [], 0
    for docs in batches:
        for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
            if held and chars + len(text or "") > HELD_CHARS:
                yield held
                held, chars = [], 0
            held.append((doc, text or ""))
            chars += len(text or "")
    if held:
        yield held


def pieces_of(path_a: str, path_b: str, width: int):
    """Batches of texts to rows of ``PIECES``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_coder, a_sizes, b_coder, b_sizes = coders(path_a, path_b)
        a_type, b_type = id_type(a_sizes), id_type(b_sizes)
        row = TaskContext.get().partitionId() << 40
        for held in blocks(batches):
            rows = []
            for (doc, text), b_list in zip(held, b_coder.encode([text for _, text in held]), strict=True):
                row += 1
                a, whole = a_coder.encode(text), (" " + text).encode()
                # Ranks go by the bytes of the text itself, so only other tokenizers need a look at theirs.
                same = a_coder.fast is not None or joined_bytes(a_coder.bytes, a.tolist()) == whole
                if not text or not same or joined_bytes(b_coder.bytes, b_list) != whole:
                    rows.append((row, doc, 0, 0, 0, 0, 0, 0, b"", b""))
                    continue
                a, b = a.astype(a_type), np.array(b_list, b_type)
                if len(a) + len(b) <= width:
                    rows.append((row, doc, 0, 1, 0, 0, len(a), len(b), a.tobytes(), b.tobytes()))
                    continue
                a_ends, b_ends = np.cumsum(a_sizes[a], dtype=np.int64), np.cumsum(b_sizes[b], dtype=np.int64)
                at_a, at_b = diagonal_cuts(a_ends, b_ends, width)
                for p in range(len(at_a) - 1):
                    i, k, j, m = at_a[p], at_a[p + 1], at_b[p], at_b[p + 1]
                    rows.append(
                        (
                            row, doc, p, len(at_a) - 1, int(a_ends[i - 1]) if i else 0, int(b_ends[j - 1]) if j else 0,
                            k - i, m - j, a[i : k + 1].tobytes(), b[j : m + 1].tobytes(),
                        )
                    )
            yield pd.DataFrame(rows, columns=named(PIECES))

    return run


class Piece:
    """Ends, ids and links of one piece. Ids have the token behind the piece at their end, if there is one."""

    def __init__(self, row, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.n_a, self.n_b = row.n_a, row.n_b
        held = (row.a_ids, a_sizes), (row.b_ids, b_sizes)
        self.a_ids, self.b_ids = (np.frombuffer(ids, id_type(sizes)).astype(np.int64) for ids, sizes in held)
        self.a_ends = row.a_at + np.cumsum(a_sizes[self.a_ids[: self.n_a]], dtype=np.int64)
        self.b_ends = row.b_at + np.cumsum(b_sizes[self.b_ids[: self.n_b]], dtype=np.int64)
        # A's ends up to each end of B; the last of them is that end itself where a group closes.
        before = np.concatenate([[row.a_at], self.a_ends])
        upto = np.searchsorted(self.a_ends, self.b_ends, "right")
        closes = before[upto] == self.b_ends
        self.close_a, self.close_b = upto[closes], np.flatnonzero(closes) + 1
        # Each distinct end closes one overlap: of the tokens that end there or reach over it.
        over = np.searchsorted(self.b_ends, self.a_ends, "left")
        self.link_a = np.concatenate([self.a_ids[: self.n_a], self.a_ids[upto[~closes]]])
        self.link_b = np.concatenate([self.b_ids[over], self.b_ids[: self.n_b][~closes]])

    def pairs(self) -> np.ndarray:
        return self.link_a << 32 | self.link_b


def keyed(pairs: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(numbers)).astype(np.int64)


def pair_counts(path_a: str, path_b: str):
    """Batches of pieces to linked id pairs with their counts, added up within the task as far as memory allows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, a_sizes, _, b_sizes = coders(path_a, path_b)
        pairs, numbers, held = [], [], 0
        for rows in batches:
            for row in rows.itertuples():
                keys, n = np.unique(Piece(row, a_sizes, b_sizes).pairs(), return_counts=True)
                pairs.append(keys)
                numbers.append(n)
                held += len(keys)
                if held > HELD_KEYS:
                    keys, n = keyed(pairs, numbers)
                    pairs, numbers, held = [keys], [n], len(keys)
                    if held > HELD_KEYS // 2:
                        yield pd.DataFrame({"pair": keys, "n": n})
                        pairs, numbers, held = [], [], 0
        if pairs:
            keys, n = keyed(pairs, numbers)
            yield pd.DataFrame({"pair": keys, "n": n})

    return run


def group_texts(piece: Piece, shown: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2`` of the piece's own tokens, as if it began and ended with groups.

    ``shown`` has the text of each id before a comma, a bar, a semicolon and nothing.
    """
    n_a, n_b = piece.n_a, piece.n_b
    # A's tokens come after the B tokens of the groups before, B's after the A tokens of their own.
    a_group = np.searchsorted(piece.close_a, np.arange(n_a), "right")
    b_group = np.searchsorted(piece.close_b, np.arange(n_b), "right")
    close_a, close_b = np.append(piece.close_a, n_a), np.append(piece.close_b, n_b)
    b_before = np.concatenate([[0], close_b])
    ids = np.empty(n_a + n_b, np.int64)
    sign = np.zeros(n_a + n_b, np.int64)
    a_place, b_place = np.arange(n_a) + b_before[a_group], np.arange(n_b) + close_a[b_group]
    ids[a_place], ids[b_place] = piece.a_ids[:n_a], piece.b_ids[:n_b]
    ends = close_a + close_b
    sign[close_a + b_before[:-1] - 1] = 1
    sign[ends - 1] = 2
    sign[-1] = 3
    return b"".join(shown[sign * (len(shown) // 4) + ids].tolist())


def shown_ids(ids: int) -> np.ndarray:
    texts = [str(i).encode() for i in range(ids)]
    return np.array([t + sign for sign in (b",", b"|", b";", b"") for t in texts], object)


def joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def search(piece: Piece, shared) -> tuple[int, int, list[dict]]:
    """Links whose count is their B id's highest, the sum of counts, and links with rarer pairs."""
    keys, counts, b_best = shared
    pairs, times = np.unique(piece.pairs(), return_counts=True)
    at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
    known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
    n, seen = counts[at[known]], times[known]
    best = int(seen[n == b_best[pairs[known] & 0xFFFFFFFF]].sum())
    rare = zip(pairs[~known].tolist(), times[~known].tolist(), strict=True)
    return best, int(n @ seen), [{"pair": p, "n": m} for p, m in rare]


def findings(path_a: str, path_b: str, shared):
    """Batches of pieces to rows of ``FOUND``; ``shared`` is a broadcast of the commonest pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, a_sizes, _, b_sizes = coders(path_a, path_b)
        shown = shown_ids(max(len(a_sizes), len(b_sizes)))
        for rows in batches:
            out = []
            for row in rows.itertuples():
                head = (row.row_id, row.doc_id, row.piece, row.pieces)
                if not row.pieces:
                    out.append((*head, *[0] * 6, "", *[""] * 5, []))
                    continue
                piece = Piece(row, a_sizes, b_sizes)
                sums = (piece.n_a, piece.n_b, len(piece.close_a), len(piece.link_a))
                best, total, rare = search(piece, shared.value)
                if row.pieces == 1:
                    digest = hashlib.sha256(group_texts(piece, shown)).hexdigest()
                    out.append((*head, *sums, best, total, digest, *[""] * 5, rare))
                    continue
                out.append((*head, *sums, best, total, None, *cut_groups(piece, shown), rare))
            yield pd.DataFrame(out, columns=named(FOUND))

    return run


def cut_groups(piece: Piece, shown: np.ndarray) -> tuple[str, str, str, str, str]:
    """A and B ids up to the first closed end, the whole groups, and the ids behind the last closed end."""
    a, b = piece.a_ids[: piece.n_a], piece.b_ids[: piece.n_b]
    if not len(piece.close_a):
        return joined(a), joined(b), "", "", ""
    i, j, k, m = piece.close_a[0], piece.close_b[0], piece.close_a[-1], piece.close_b[-1]
    inner = Piece.__new__(Piece)
    inner.a_ids, inner.b_ids, inner.n_a, inner.n_b = a[i:k], b[j:m], int(k - i), int(m - j)
    inner.close_a, inner.close_b = piece.close_a[1:-1] - i, piece.close_b[1:-1] - j
    body = group_texts(inner, shown).decode() if inner.n_a + inner.n_b else ""
    return joined(a[:i]), joined(b[:j]), body, joined(a[k:]), joined(b[m:])


def stitch(rows: pd.DataFrame) -> pd.DataFrame:
    """The digest of one text's groups out of its pieces, those cut by piece edges put together."""
    digest, started = hashlib.sha256(), False
    a, b = [], []
    for row in rows.sort_values("piece").itertuples():
        a.append(row.lead_a)
        b.append(row.lead_b)
        if not row.n_groups:
            continue
        groups = [f"{','.join(filter(None, a))}|{','.join(filter(None, b))}", row.body]
        for group in filter(None, groups):
            digest.update((";" if started else "").encode() + group.encode())
            started = True
        a, b = [row.tail_a], [row.tail_b]
    return pd.DataFrame({"row_id": rows["row_id"].iloc[:1], "stitched": [digest.hexdigest()]})


def commonest(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Pairs whose count reaches a limit that at most ``most`` of them do, and that limit."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least"))
    limit, held = None, 0
    for row in sizes.orderBy(F.desc("step")).collect():  # at most 8 x 64 rows
        held += row["pairs"]
        if held > most:
            break
        limit = row["least"]
    return counts.filter(F.col("n") >= limit if limit is not None else F.lit(False)), limit


def align(docs: DataFrame, path_a: str, path_b: str, width: int = WIDTH, most: int = MOST_PAIRS) -> DataFrame:
    """Sizes, links and groups of every text (doc_id, text) in both tokenizers."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    pieces = store(texts.mapInPandas(pieces_of(path_a, path_b, width), PIECES), "token-pieces")

    counted = pieces.filter("pieces > 0").mapInPandas(pair_counts(path_a, path_b), "pair long, n long")
    counts = store(counted.groupBy("pair").agg(F.sum("n").alias("n")), "token-pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("n"))
    common, limit = commonest(counts, most)
    table = common.toPandas().sort_values("pair")  # bounded by ``most``
    best = highest.toPandas()  # one row for each id of B at most
    b_best = np.zeros(1 + int(best["b"].max()) if len(best) else 1, np.int64)
    b_best[best["b"]] = best["n"]
    shared = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), b_best))

    found = store(pieces.mapInPandas(findings(path_a, path_b, shared), FOUND), "token-links")
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    whole = (F.col("pieces") <= 1) & (F.size("rare") == 0)

    rarer = counts.filter(F.col("n") < limit) if limit is not None else counts
    rarer = rarer.select("pair", F.col("n").alias("pair_n"), b_id.alias("b"))
    asked = found.filter(F.size("rare") > 0).select("row_id", F.inline("rare"))
    answered = asked.join(rarer, "pair").join(F.broadcast(highest.withColumnRenamed("n", "top")), "b")
    rare_sums = answered.groupBy("row_id").agg(
        F.sum(F.when(F.col("pair_n") == F.col("top"), F.col("n")).otherwise(0)).alias("rare_best"),
        F.sum(F.col("n") * F.col("pair_n")).alias("rare_sum"),
    )
    cut = found.filter("pieces > 1")
    stitched = cut.select("row_id", "piece", "n_groups", "lead_a", "lead_b", "body", "tail_a", "tail_b").groupBy(
        "row_id"
    ).applyInPandas(stitch, "row_id long, stitched string")
    parted = found.filter(~whole).groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums], F.max("groups_sha256").alias("groups_sha256")
    )
    parted = parted.join(rare_sums, "row_id", "left").join(stitched, "row_id", "left")
    none = F.lit(0).cast("long")
    parted = parted.withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("rare_best", none),
            "count_sum": F.col("count_sum") + F.coalesce("rare_sum", none),
            "groups_sha256": F.coalesce("stitched", "groups_sha256"),
        }
    )
    columns = (F.col("doc_id").cast("long").alias("doc_id"), *sums, "groups_sha256")
    return found.filter(whole).select(*columns).unionByName(parted.select(*columns))
