"""Document fingerprints by winnowing.

A text is lower-cased (A-Z) and cut into units: words, and pieces of runs of more than 16 characters.
Such a run is cut before the place of the smallest hash (of equal ones the rightmost) of every
``PIECE`` in a row of its hashes of ``LOCAL`` characters. Pieces thus have 16 characters at most, and
where a cut falls depends on the characters around it only, not on where the run begins: two runs
that share a passage have the same cuts from ``PIECE`` characters behind its start to ``PIECE`` +
``LOCAL`` before its end. A shared passage of 150 characters holds a run of eight units at least.
Every ``k`` units in a row are hashed; of every ``window`` hashes in a row the smallest is chosen,
of equal ones the rightmost. The chosen hashes with their places are the fingerprint. Two texts that
share a run of ``window + k - 1`` units share a chosen hash, and nothing below ``k`` units counts.

All work is done row by row by built-in functions. The choice of a window is the least of a few
longs, each a hash with its place in the low bits, so ties need no second pass.

``with_next`` brings each document its successor in id order. Ids are cut into blocks at
approximate quantiles (at most ``MAX_BLOCKS``, whose upper ends go through the driver); each text is
shuffled once, to its block, and a block's first document once more to the block before. An id that
holds the rows of several blocks (as null may) is cut further, by the hashes of its texts.

Defined cases: a null text counts as empty and has an empty fingerprint; a text of fewer than ``k``
units has one hash, of all of them; two empty fingerprints are alike (1), an empty and another are
not (0); rows with the same id follow each other in the order of their texts, or of their texts' hashes
where an id holds several blocks; rows equal in id and text share a block; a single row follows itself; a null id comes last; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from farelens.llm.common import WORD, bind, fold, steps

K, WINDOW = 5, 4
PLACE_BITS = 26
MAX_BLOCKS = 16384
BLOCK_ROWS, LEAST_BLOCK_ROWS = 1000, 50
_FINE = 128
WHOLE = (1 << 63) - 1  # the place of rows whose id is not cut by hashes
LONGEST, PIECE, LOCAL = 16, 13, 4
LONG_RUN = r"[^\x20\x09-\x0D]{17}"


def least_places(values: Column, window: int) -> Column:
    """Ascending places of the least of every ``window`` longs in a row, by their upper bits; empty for none."""
    mask = (1 << PLACE_BITS) - 1
    tagged = F.transform(
        values,
        lambda v, i: F.shiftleft(F.shiftright(v, PLACE_BITS), PLACE_BITS)
        + (F.lit(mask).cast("long") - F.pmod(i.cast("long"), F.lit(mask + 1))),
    )

    def least(t: Column) -> Column:
        sliding = F.transform(
            steps(F.size(t) - (window - 1)), lambda i: F.least(*[t[i + j] for j in range(window)])
        )
        single = F.array(F.array_min(t))
        return F.when(F.size(t) >= window, sliding).when(F.size(t) > 0, single).otherwise(F.array().cast("array<bigint>"))

    place = lambda p: (F.lit(mask).cast("long") - p.bitwiseAND(F.lit(mask).cast("long"))).cast("int")
    return F.transform(F.array_distinct(bind(tagged, least)), place)


def pieces(run: Column) -> Column:
    """A run of more than 16 characters, cut where its characters say so."""

    def cut(chars: Column) -> Column:
        local = F.transform(
            steps(F.size(chars) - (LOCAL - 1)), lambda i: F.xxhash64(*[chars[i + j] for j in range(LOCAL)])
        )
        starts = F.array_distinct(F.concat(F.array(F.lit(0)), bind(local, lambda h: least_places(h, PIECE))))

        def between(at: Column) -> Column:
            end = lambda i: F.coalesce(F.get(at, i + 1), F.size(chars))
            return F.transform(at, lambda a, i: F.array_join(F.slice(chars, a + 1, end(i) - a), ""))

        return bind(starts, between)

    return bind(F.split(run, ""), cut)


def units(text: Column) -> Column:
    def of(folded: Column) -> Column:
        runs = F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))
        short = lambda r: F.length(r) <= LONGEST
        cut = F.flatten(F.transform(runs, lambda r: F.when(short(r), F.array(r)).otherwise(pieces(r))))
        return F.when(folded.rlike(LONG_RUN), cut).otherwise(runs)

    return bind(fold(text), of)


def gram_hashes(text: Column, k: int = K) -> Column:
    """Hashes of every ``k`` units in a row."""

    def rolled(h: Column) -> Column:
        grams = F.transform(steps(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))
        short = F.array(F.xxhash64(F.array_join(h, ",")))
        return F.when(F.size(h) >= k, grams).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(units(text), lambda u: F.xxhash64(u)), rolled)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<struct<hash, place>> of a text that is not null, in text order."""

    def chosen(grams: Column) -> Column:
        placed = lambda at: F.struct(F.get(grams, at).alias("hash"), at.alias("place"))
        return F.transform(least_places(grams, window), placed)

    return bind(gram_hashes(text, k), chosen)


def hashes(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda x: x["hash"]))


def as_text(print_: Column) -> Column:
    """Hash and place of each chosen gram."""
    one = lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), x["place"].cast("string"))
    return F.array_join(F.transform(print_, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of either that both have."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        bind(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    )


def with_fingerprint(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds fingerprint, replacing a column of that name."""
    return docs.withColumn("fingerprint", fingerprint(F.coalesce(F.col(text), F.lit("")), k, window))


def block_heads(docs: DataFrame, key: Column, text: Column) -> list[tuple[int, int]]:
    """Highest (key, hash) of each block that holds rows, descending.

    A key that ends more than one block holds the rows of several. It is cut further by the hashes of its
    texts, at even steps; all other keys have ``WHOLE`` for a hash, above which there is none.
    """
    spark = docs.sparkSession
    rows = docs.count()
    if not rows:
        return []
    dealt = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(rows // BLOCK_ROWS, min(rows // LEAST_BLOCK_ROWS, dealt), 1)
    blocks = min(blocks, MAX_BLOCKS)
    shares = [i / blocks for i in range(1, blocks + 1)]
    ends = docs.select(F.percentile_approx(key, shares, 4 * blocks)).first()[0]
    top = docs.agg(F.max(key)).first()[0]
    hot = {k: n for k, n in Counter(ends).items() if n > 1}
    heads = {(k, WHOLE) for k in {*ends, top} - hot.keys()}
    if hot:
        upper = F.shiftright(F.xxhash64(text), 16) + (1 << 47)  # 48 bits, from 0
        step = F.shiftright(upper * F.element_at(_table(hot), key), 48)
        cut = docs.filter(key.isin(*hot)).select(key.alias("k"), step.alias("step"), F.xxhash64(text).alias("h"))
        heads |= {(r.k, r.h) for r in cut.groupBy("k", "step").agg(F.max("h").alias("h")).collect()}
    return sorted(heads, reverse=True)


def _longs(values: Iterable[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _table(counts: dict[int, int]) -> Column:
    return F.map_from_arrays(_longs(counts), _longs(counts.values()))


def with_next(docs: DataFrame, carried: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with block, guest and place to be read by ``successor``: guests only follow others."""
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("long"))
    heads = block_heads(docs, order, F.col(text))
    keyed = docs.select(key, *carried, order.alias("__key"))
    if not heads:
        return keyed.withColumns({"__hash": F.lit(WHOLE), "__block": F.lit(0), "__guest": F.lit(False)})
    hot = sorted({k for k, h in heads if h != WHOLE})
    hashed = F.when(F.col("__key").isin(*hot), F.xxhash64(text)).otherwise(F.lit(WHOLE)) if hot else F.lit(WHOLE)

    def above(some: list[tuple[int, int]], first: Column | None = None) -> Column:
        """How many of ``some`` heads (or of ``_FINE`` from ``first`` on) are not below the row."""
        listed = F.arrays_zip(_longs(k for k, _ in some).alias("k"), _longs(h for _, h in some).alias("h"))
        part = listed if first is None else F.slice(listed, first, F.lit(_FINE))
        reaches = lambda x: (x["k"] > F.col("__key")) | (x["k"] == F.col("__key")) & (x["h"] >= F.col("__hash"))
        return F.size(F.filter(part, reaches))

    fine = bind(above(heads[::_FINE]) - 1, lambda c: c * _FINE + above(heads, c * _FINE + 1) - 1)
    is_head = (F.get(_longs(k for k, _ in heads), F.col("__block")) == F.col("__key")) & (
        F.get(_longs(h for _, h in heads), F.col("__block")) == F.col("__hash")
    )
    before = F.when(F.col("__block") == 0, len(heads) - 1).otherwise(F.col("__block") - 1)
    own = F.array(F.struct(F.col("__block").alias("b"), F.lit(False).alias("g")))
    guest = F.struct(before.alias("b"), F.lit(True).alias("g"))
    placed = keyed.withColumn("__hash", hashed).withColumn("__block", fine)
    dealt = placed.withColumn("__to", F.explode(F.when(is_head, F.concat(own, F.array(guest))).otherwise(own)))
    return dealt.select(
        key, *carried, "__key", "__hash", F.col("__to.b").alias("__block"), F.col("__to.g").alias("__guest")
    )


def successor(value: Column, tie: str) -> Column:
    """``value`` of the next row in descending key order, over rows of ``with_next``."""
    return F.lead(value).over(
        Window.partitionBy("__block").orderBy("__guest", F.col("__key").desc(), F.col("__hash").desc(), F.col(tie))
    )


def edited(text: Column, following: Column) -> Column:
    """The last third replaced by as many characters from the start of the next text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def fingerprint_report(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text, its edited form, and their likeness to each other and the next."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chained = with_next(texts, ["text"])
    changed = chained.withColumn("__next", F.coalesce(successor(F.col("text"), "text"), F.lit(""))).withColumn(
        "__edited", edited(F.col("text"), F.col("__next"))
    )
    printed = changed.select(
        "doc_id", "__block", "__guest", "__key", "__hash", "text",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), k, window).alias("__own"),
        fingerprint(F.col("__edited"), k, window).alias("__changed"),
    )
    sets = printed.withColumns({"__a": hashes(F.col("__own")), "__b": hashes(F.col("__changed"))})
    both = sets.withColumn("__c", successor(F.col("__a"), "text")).filter(~F.col("__guest"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("__own")).alias("fingerprint"), as_text(F.col("__changed")).alias("edited_fingerprint"),
        likeness(F.col("__a"), F.col("__b")).alias("near_edited"),
        likeness(F.col("__a"), F.col("__c")).alias("near_next"),
    )
