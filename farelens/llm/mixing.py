"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of all words. No target may exceed ``max_epochs`` times
what the source has; what lies above is shared out again by weight among the rest until no target
is above its cap. Every document is then taken ``floor(target / source words)`` times whole, and
the remainder is filled with once more of the documents that come first in a seeded order.

Nothing is sorted or gathered by source: the order is a digest, cut into 4,096 slices. Word sums
per slice tell in which slice a source's remainder ends, and only that slice is put in order. What
is kept per source (one row: as many as the mix has weights) is broadcast.

Defined cases: null text has 0 words and is taken 0 words; a null source is a source of its own,
last in order; sources without words have target 0; rows equal in id and text are taken or left
together; an empty table gives an empty result; input columns with the names of the results are
replaced, all others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from farelens.llm.common import WORD, store, text_or_empty

SLICE_DIGITS = 3
# Short documents, that fill what is left open, have at most this part of it.
FILL_SHARE = 2
RESULTS = ("size", "source_size", "target", "taken")


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    target: float

    @property
    def whole(self) -> int:
        return int(self.target // self.size) if self.size else 0

    @property
    def need(self) -> float:
        """Words still missing after the whole repetitions."""
        return self.target - self.whole * self.size


def water_fill(
    sizes: list[tuple[str | None, int]], weights: tuple[float, ...], max_epochs: float
) -> list[Share]:
    """Targets by source; ``weights`` repeat over the sources in code point order, null last.

    Sources reach their caps in the order of cap by weight, so one pass over that order finds the
    level at which the rest is shared.
    """
    named = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    rows = [(source, size, weights[i % len(weights)]) for i, (source, size) in enumerate(named)]
    words_left, weight_left = sum(s for _, s, _ in rows), sum(w for *_, w in rows)
    shares, level = [], None
    for source, size, weight in sorted(rows, key=lambda r: r[1] * max_epochs / r[2]):
        cap = size * max_epochs
        if level is None:
            now = words_left / weight_left
            if cap / weight < now:
                shares.append(Share(source, size, float(cap)))
                words_left, weight_left = words_left - cap, weight_left - weight
                continue
            level = now
        shares.append(Share(source, size, weight * level))
    return shares


def measure(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``size`` and the place in the seeded order, ``__order``."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty())
    return docs.withColumns(
        {
            "size": F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"),
            "__order": F.md5(key.cast("binary")),
        }
    )


def prefix_cuts(
    pool: DataFrame, needs: dict[str | None, float], nearest: bool
) -> dict[str | None, tuple[str, int]]:
    """By source, the last place in order up to which documents fill ``needs``, and their words.

    A document that would overshoot is left out or, with ``nearest``, taken if at least half of it
    is needed. ``pool`` has source, size and __order.
    """
    spark = pool.sparkSession
    needs = {k: float(v) for k, v in needs.items() if v > 0}
    if not needs:
        return {}
    goals = F.broadcast(spark.createDataFrame(list(needs.items()), "__source string, __need double"))
    sliced = pool.select("source", "size", "__order", F.substring("__order", 1, SLICE_DIGITS).alias("slice"))
    running = Window.partitionBy("source").orderBy("slice")
    ends = (
        sliced.groupBy("source", "slice")
        .agg(F.sum("size").alias("n"))
        .withColumn("after", F.sum("n").over(running))
        .join(goals, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("before", F.col("after") - F.col("n"))
    )
    at = ends.groupBy("__source", "__need").agg(
        F.max("after").alias("total"),
        F.min(F.when(F.col("after") >= F.col("__need"), F.struct("before", "slice"))).alias("end"),
    )
    edges = at.collect()
    cuts = {r["__source"]: ("g", r.total) for r in edges if r.end is None}  # all of it is needed
    inner = [(r["__source"], r["__need"], r.end.before, r.end.slice) for r in edges if r.end is not None]
    cuts |= {source: (part, before) for source, _, before, part in inner}
    if not inner:
        return cuts
    bounds = spark.createDataFrame(inner, "__source string, __need double, before long, __slice string")
    inside = sliced.join(
        F.broadcast(bounds),
        F.col("source").eqNullSafe(F.col("__source")) & (F.col("slice") == F.col("__slice")),
    )
    ordered = Window.partitionBy("__source").orderBy("__order")
    upto = F.col("before") + F.sum("n").over(ordered)
    slack = F.col("n") / 2 if nearest else F.lit(0)
    found = (
        inside.groupBy("__source", "__order", "before", "__need")
        .agg(F.sum("size").alias("n"))
        .withColumn("upto", upto)
        .filter(F.col("upto") - slack <= F.col("__need"))
        .groupBy("__source")
        .agg(F.max("__order").alias("cut"), F.max("upto").alias("words"))
        .collect()
    )
    return cuts | {r["__source"]: (r.cut, r.words) for r in found}


def plan_mix(
    measured: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3
) -> DataFrame:
    """One row per source: words, target, whole repetitions and which documents come once more.

    First the documents up to a place in the seeded order, as far as none overshoots; then, for
    what a long document left open, short ones from behind that place. ``measured`` is read
    several times and should be stored.
    """
    spark = measured.sparkSession
    sums = measured.groupBy("source").agg(F.sum("size").alias("n")).collect()
    shares = water_fill([(r.source, r.n) for r in sums], weights, max_epochs)
    first = prefix_cuts(measured, {s.source: s.need for s in shares}, nearest=False)
    open_words = {s.source: s.need - first[s.source][1] for s in shares if s.source in first}
    state = spark.createDataFrame(
        [(source, cut, open_words[source] / FILL_SHARE) for source, (cut, _) in first.items()],
        "__source string, __cut string, __short double",
    )
    behind = measured.join(
        F.broadcast(state),
        F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__order") > F.col("__cut"))
        & (F.col("size") <= F.col("__short")),
    )
    second = prefix_cuts(behind, open_words, nearest=True)
    return spark.createDataFrame(
        [
            (
                s.source, s.size, s.target, s.whole, first.get(s.source, ("", 0))[0],
                second.get(s.source, ("", 0))[0], open_words.get(s.source, 0.0) / FILL_SHARE,
            )
            for s in shares
        ],
        "__source string, source_size long, target double, __whole long, __cut string,"
        " __cut_short string, __short double",
    )


def apply_mix(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, ``repeats`` (times a document is taken) and taken (words)."""
    kept = [c for c in measured.columns if c not in ("source_size", "target", "repeats", "taken")]
    once_more = (F.col("__order") <= F.col("__cut")) | (
        (F.col("size") <= F.col("__short")) & (F.col("__order") <= F.col("__cut_short"))
    )
    repeats = F.col("__whole") + F.when(once_more, 1).otherwise(0)
    return (
        measured.select(kept)
        .join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("repeats", repeats)
        .withColumn("taken", F.col("size") * F.col("repeats"))
        .drop("__source", "__whole", "__cut", "__cut_short", "__short", "__order")
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 0
) -> DataFrame:
    """Documents with size, source_size, target, repeats and taken."""
    return apply_mix(measure(docs, seed), _plan(docs, weights, max_epochs, seed))


def mix_report(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 0
) -> DataFrame:
    """As ``mix`` without texts: doc_id, size, source_size, target, taken."""
    measured = _stored(docs, seed)
    return apply_mix(measured, plan_mix(measured, weights, max_epochs)).select("doc_id", *RESULTS)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each document as many times as it is taken."""
    times = mixed.filter(F.col("repeats") > 0).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    )
    return times.drop("__copy")


def _stored(docs: DataFrame, seed: int) -> DataFrame:
    return store(measure(docs, seed).select("doc_id", "source", "size", "__order"), "mix")


def _plan(docs: DataFrame, weights, max_epochs, seed) -> DataFrame:
    return plan_mix(_stored(docs, seed), weights, max_epochs)
