"""Near-duplicates by an inverted join of MinHash signature coordinates.

Texts are lower-cased (A-Z), cut into words, and seen as sets of five-word shingles. Texts with equal
sets form a class; only classes are compared. A class's signature has ``COORDINATES`` minima. It is
posted under each coordinate-value pair; pairs posted once are skipped, as nothing collides there.
Two signatures that agree in ``Limits.matches`` coordinates share a posting among the first
``COORDINATES - matches + 1`` of either, in ascending order of list length, so only that prefix is
merged: very common values come last and hardly ever take part.

Lists of up to ``SHORT_LIST`` classes give their pairs at once. Longer lists come from groups of very
many similar texts: those that overlap are merged into clusters, whose members are compared in blocks
(each task sees two blocks of bounded size), and a task reports only the links that join what it has
not joined yet. Every pair with enough matches is decided on the full sets:
100 * intersection >= ``Limits.percent`` * union. Keys that hold many rows, be they coordinates, groups or
copies, are joined by broadcasts of bounded size. ``AT_85`` and ``AT_80`` have sieves fitted to their
similarity: the expected loss, at exactly that similarity, is one pair in some ten thousand.

Defined cases: texts without words have an empty set, belong to no class and link with nothing;
texts of fewer words than five have one shingle, the whole sequence; equal rows are one class;
null ids come last in the order that picks a group's first document; an empty table gives an empty
result; other input columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from farelens.llm.common import WORD, store
from farelens.llm.components import components
from farelens.operators.joins import left_lookup

WORDS = 5
PERCENT = 85
COORDINATES = 32
SHORT_LIST = 16
BLOCK_CLASSES, BLOCK_BYTES = 1024, 24_000_000
# A second signature, of single bytes, sorts out pairs within a block before sets are compared.
BYTES = 256
SIGNED = "row_id long, doc_id long, text_hash long, n_shingles long, digest binary, minima array<int>"


@dataclass(frozen=True)
class Limits:
    """The similarity of a link, and how many coordinates and bytes of a pair agree at least."""

    percent: int
    matches: int
    byte_matches: int


AT_85 = Limits(PERCENT, 19, 188)
AT_80 = Limits(80, 16, 176)
_random = np.random.default_rng(20240601)
_MIX = _random.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _random.integers(0, 1 << 31, COORDINATES + BYTES, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, COORDINATES + BYTES, np.uint32)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    if n > 0:
        mixed = keys[:n] * _MIX[0]
        for i in range(1, WORDS):
            mixed += keys[i : i + n] * _MIX[i]
    else:
        mixed = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9FB21C651E98DF25)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(shingle_hashes: np.ndarray, first: int, count: int) -> np.ndarray:
    """Least value of each of ``count`` hash functions over a set that is not empty."""
    folded = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
    a, b = _FACTORS[first : first + count], _SHIFTS[first : first + count]
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 2048):
        np.minimum(least, (folded[i : i + 2048, None] * a + b).min(axis=0), out=least)
    return least


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lane, made = TaskContext.get().partitionId(), 0
    for docs in batches:
        rows = []
        for doc, text, text_hash in zip(docs["doc_id"], docs["text"], docs["text_hash"], strict=True):
            found = shingles(text or "")
            digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
            least = minima(found, 0, COORDINATES).view(np.int32) if len(found) else None
            rows.append(((lane << 40) + made, None if pd.isna(doc) else doc, text_hash, len(found), digest, least))
            made += 1
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNED.split(", ")]).astype({"doc_id": "Int64"})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in batches:
        found = [shingles(t or "") for t in docs["text"]]
        yield pd.DataFrame(
            {"digest": [xxhash.xxh3_128_digest(f.tobytes()) for f in found], "shingles": [f.tobytes() for f in found]}
        )


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _linked(percent: int) -> Callable[[pd.Series, pd.Series], pd.Series]:
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True))
        return pd.Series([similar(x, y, percent) for x, y in sets], dtype=bool)

    return linked


def block_links(members: pd.DataFrame, limits: Limits = AT_85) -> pd.DataFrame:
    """Links that join the classes of two blocks (or one) of a cluster, as far as they are not joined."""
    ids = members["class"].to_numpy()
    blocks = members["block"].to_numpy()
    across = blocks.min() != blocks.max()
    sets = [np.frombuffer(s, np.uint64) for s in members["shingles"]]
    marks = np.stack([minima(s, COORDINATES, BYTES) for s in sets]).astype(np.uint8)
    root = np.arange(len(ids))
    links = []
    for i in range(len(ids)):
        matches = (marks[i + 1 :] == marks[i]).sum(axis=1)
        near = np.flatnonzero(matches >= limits.byte_matches) + i + 1
        if across:
            near = near[blocks[near] != blocks[i]]
        for j in near[np.argsort(-matches[near - i - 1], kind="stable")]:
            if root[i] != root[j] and similar(sets[i], sets[j], limits.percent):
                links.append((ids[i], ids[j]))
                root[root == root[j]] = root[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def signed(docs: DataFrame) -> DataFrame:
    """One row per document with its set's size, digest and signature."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(texts.withColumn("text_hash", F.xxhash64("text")).mapInPandas(_sign, SIGNED), "signatures")


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(class, key, n): the postings of each class that are merged, n being their list's length."""
    posted = classes.select("class", F.posexplode("minima").alias("place", "least")).select(
        "class", (F.col("place").cast("long") * (1 << 32) + F.col("least")).alias("key")
    )
    shared = store(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    colliding = left_lookup(posted, shared, "key", F.col("n")).filter("n IS NOT NULL")
    by_class = Window.partitionBy("class")
    alone = F.lit(COORDINATES) - F.count("*").over(by_class)  # values that no other class has come first
    place = F.row_number().over(by_class.orderBy("n", "key"))
    ranked = colliding.withColumns({"alone": alone, "place": place})
    prefix = store(
        ranked.filter(F.col("place") + F.col("alone") <= COORDINATES - matches + 1).select("class", "key"), "prefixes"
    )
    lists = store(prefix.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    return store(left_lookup(prefix, lists, "key", F.col("n")).filter("n IS NOT NULL"), "postings")


def short_list_pairs(postings: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) of short lists that agree in enough coordinates."""
    lists = postings.filter(F.col("n") <= SHORT_LIST).groupBy("key").agg(F.sort_array(F.collect_list("class")).alias("m"))
    paired = F.flatten(
        F.transform(
            "m",
            lambda x, i: F.transform(
                F.slice("m", i + 2, F.lit(SHORT_LIST)), lambda y: F.struct(x.alias("a"), y.alias("b"))
            ),
        )
    )
    pairs = lists.select(F.explode(paired).alias("p")).select("p.a", "p.b").distinct()
    of = lambda side: classes.select(F.col("class").alias(side), F.col("minima").alias(f"{side}_minima"))
    matched = F.size(F.filter(F.zip_with("a_minima", "b_minima", lambda x, y: x == y), lambda same: same))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(matched >= matches).select("a", "b")


def clusters(postings: DataFrame) -> DataFrame:
    """(class, cluster) of classes whose long lists overlap."""
    long_lists = postings.filter(F.col("n") > SHORT_LIST)
    hubs = long_lists.groupBy("key").agg(F.min("class").alias("b"), F.count("*").alias("times"))
    edges = left_lookup(long_lists, hubs, "key", F.col("times")).select(F.col("class").alias("a"), "b")
    return components(edges).select(F.col("node").alias("class"), F.col("component").alias("cluster"))


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, shingles) for ``classes`` (class, own, digest), from the texts of their first documents."""
    wanted = classes.select(F.col("own.doc_id").alias("__id"), F.col("own.text_hash").alias("__hash")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    found = texts.join(wanted, same, "left_semi").select("text").mapInPandas(_sets, "digest binary, shingles binary")
    unique = found.join(classes.select("class", "digest"), "digest").dropDuplicates(["class"])
    return store(unique.select("class", "shingles"), "sets")


def cluster_links(members: DataFrame, sets: DataFrame, limits: Limits) -> DataFrame:
    """Links within clusters, found by blocks."""
    filled = members.join(sets, "class")
    sizes = filled.groupBy("cluster").agg(
        F.ceil(
            F.greatest(F.count("*") / BLOCK_CLASSES, F.sum(F.length("shingles")) / BLOCK_BYTES)
        ).cast("int").alias("blocks"),
        F.count("*").alias("classes"),
    )
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = (
        left_lookup(filled, sizes, "cluster", F.col("classes"))
        .drop("classes")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    )
    return dealt.groupBy("cluster", "low", "high").applyInPandas(lambda m: block_links(m, limits), "a long, b long")


def near_duplicates(docs: DataFrame, limits: Limits = AT_85) -> DataFrame:
    """One row per document: row_id, doc_id, text_hash, n_shingles, component_id and first_hash.

    ``first_hash`` is the text hash of the group's first document, by id and then by text hash.
    """
    rows = signed(docs)
    no_id = F.col("doc_id").isNull().alias("no_id")
    first = F.min(F.struct(no_id, "doc_id", "row_id"))
    classes = store(
        rows.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            first.alias("first"),
            F.min(F.struct(no_id, "doc_id", "text_hash")).alias("own"),
            F.first("minima").alias("minima"),
            F.count("*").alias("copies"),
        )
        .select(
            F.col("first.row_id").alias("class"), F.col("first.doc_id").alias("doc_id"), "own", "digest", "minima", "copies"
        ),
        "classes",
    )
    postings = prefix_postings(classes, limits.matches)
    pairs = store(short_list_pairs(postings, classes, limits.matches), "pairs")
    members = store(clusters(postings), "clusters")
    used = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
    used = used.unionByName(members.select("class")).distinct()
    sets = full_sets(docs, classes.join(used, "class").select("class", "own", "digest"))
    side = lambda name: sets.select(F.col("class").alias(name), F.col("shingles").alias(f"{name}_set"))
    reached = F.pandas_udf(_linked(limits.percent), "boolean")("a_set", "b_set")
    confirmed = pairs.join(side("a"), "a").join(side("b"), "b").filter(reached)
    links = confirmed.select("a", "b").unionByName(cluster_links(members, sets, limits))
    grouped = components(links)
    named = (
        grouped.join(classes.select(F.col("class").alias("node"), "doc_id", "own"), "node")
        .groupBy("component")
        .agg(F.min("doc_id").alias("least"), F.min("own").alias("group_first"), F.count("*").alias("nodes"))
    )
    by_class = left_lookup(grouped, named, "component", F.col("nodes")).select(F.col("node").alias("class"), "least", "group_first")
    by_digest = classes.join(by_class, "class", "left").select(
        "digest", F.coalesce("least", "doc_id").alias("component_id"), F.col("class").alias("__class"),
        F.coalesce("group_first.text_hash", "own.text_hash").alias("first_hash"), "copies",
    )
    known = left_lookup(rows.drop("minima"), store(by_digest, "by-digest"), "digest", F.col("copies"))
    return known.select(
        "row_id", "doc_id", "text_hash", "n_shingles",
        F.when(F.col("__class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "first_hash",
    )


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def duplicate_report(docs: DataFrame, limits: Limits = AT_85) -> DataFrame:
    return near_duplicates(docs, limits).select("doc_id", "n_shingles", "component_id", kept().alias("kept"))


def first_of_each_group(docs: DataFrame, limits: Limits = AT_85) -> DataFrame:
    """Documents without those that have a kept near-duplicate; texts without words all stay."""
    judged = store(near_duplicates(docs, limits), "near-duplicates")
    first = kept() & F.coalesce(F.col("text_hash") == F.col("first_hash"), F.lit(True))
    keys = judged.groupBy("doc_id", "text_hash").agg(
        F.max(first).alias("stays"), F.max(F.col("n_shingles") > 0).alias("has_words"), F.count("*").alias("times")
    )
    keys = store(keys, "near-duplicate-keys")
    gone = keys.filter("NOT stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    left = docs.withColumn("__text_hash", F.xxhash64("text")).join(
        gone,
        F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")),
        "left_anti",
    )
    if keys.filter("stays AND has_words AND times > 1").limit(1).count():
        worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
        left = left.filter(worded).dropDuplicates(["doc_id", "__text_hash"]).unionByName(left.filter(~worded))
    return left.drop("__text_hash")
