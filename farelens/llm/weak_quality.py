"""Quality by weak supervision: rules vote or abstain, and a latent quality explains the votes.

Each rule turns a few counts of a text into a vote: good, bad or none. Expectation-maximisation over
the counts of vote patterns (at most 3 to the number of rules, whatever the input) estimates how
often each rule votes how on good and on bad documents, and with that each pattern's probability of
being good. A document is kept if that probability reaches ``threshold`` and the two fixed base
rules hold.

All counting is done by built-in functions, row by row; only the pattern counts are shuffled.
Texts are split into words once, 3-word windows are hashed and sorted within the row, and equal
neighbours are compared word by word, so a hash never decides alone.

Defined cases: a null text counts as empty; texts without words have all counts 0, every rule
abstains, and they fail the base rules; equal texts get equal results; an empty table gives an empty
result; input columns with the names of the results are replaced, all others kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from farelens.llm.common import SPACE, WORD, bind, steps, store, text_or_empty, words

GOOD, BAD, ABSTAIN = "g", "b", "-"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FIRST_HIT = 0.3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULE_MEASURES = ("n_lines", "n_capitals", "n_shouts", "n_closed_lines")


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on, good up to ``good``, and abstains between and without words.

    ``false_alarm`` bounds how often it votes bad on good documents.
    """

    name: str
    value: Column
    good: float
    bad: float
    false_alarm: float

    def vote(self) -> Column:
        return (
            F.when((F.col("n_words") == 0) | self.value.isNull(), ABSTAIN)
            .when(self.value >= self.bad, BAD)
            .when(self.value <= self.good, GOOD)
            .otherwise(ABSTAIN)
        )


def per(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def rules() -> list[Rule]:
    mean_word = per("word_chars", "n_words")
    return [
        Rule("symbols", per("n_symbols", "n_words"), 0.02, 0.15, 0.001),
        Rule("shouting", per("n_shouts", "n_words"), 0.05, 0.3, 0.001),
        Rule("capitals", per("n_capitals", "word_chars"), 0.1, 0.4, 0.005),
        Rule("repeated words", per("n_repeat_words", "n_words"), 0.1, 0.3, 0.002),
        Rule("repeated lines", per("n_dup_lines", "n_lines"), 0.05, 0.3, 0.2),
        Rule("word length", F.abs(mean_word - 6), 3.0, 6.0, 0.2),
        Rule("open lines", 1 - per("n_closed_lines", "n_lines"), 0.3, 0.9, 0.5),
    ]


def high(value: Column, bits: Column) -> Column:
    """A long without its lowest ``bits``."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def repeated_word_count(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; ``w`` is an array in a variable."""

    def covered(n, bits, ordered):
        place = lambda j: F.get(ordered, j) - high(F.get(ordered, j), bits)
        prefix = lambda j: F.call_function("shiftright", F.get(ordered, j), bits)

        def same(j, k):
            equal_words = bind(
                F.array(place(j).cast("int"), place(k).cast("int")),
                lambda p: (w[p[0]] == w[p[1]]) & (w[p[0] + 1] == w[p[1] + 1]) & (w[p[0] + 2] == w[p[1] + 2]),
            )
            return F.when(prefix(j) == prefix(k), equal_words).otherwise(False)

        found = F.filter(steps(F.size(ordered)), lambda j: same(j, j - 1) | same(j, j + 1))
        starts = F.array_sort(F.transform(found, place))
        return bind(
            starts,
            lambda s: F.aggregate(
                steps(F.size(s)),
                F.lit(0).cast("long"),
                lambda total, j: total + F.least(F.lit(3).cast("long"), F.coalesce(F.get(s, j + 1) - F.get(s, j), F.lit(3).cast("long"))),
            ),
        )

    # A window's place takes just the low bits that it needs, the hash all others.
    return bind(
        F.length(F.bin(F.size(w).cast("long"))),
        lambda bits: bind(
            F.sort_array(
                F.transform(
                    steps(F.size(w) - 2),
                    lambda i: high(F.xxhash64(w[i], w[i + 1], w[i + 2]), bits)
                    + i.cast("long"),
                )
            ),
            lambda ordered: covered(F.size(w), bits, ordered),
        ),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts and those the rules need."""
    value = text_or_empty(text)
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(WORD))
    by_words = bind(words(value), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_word_count(w).alias("r")))
    by_lines = bind(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("d"),
            F.size(F.filter(ls, lambda line: line.rlike(r"[.!?:;\"')\]]\s*$"))).cast("long").alias("c"),
        ),
    )
    counted = docs.withColumns({"__w": by_words, "__l": by_lines})
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("long")
    return counted.withColumns(
        {
            "n_words": F.coalesce(F.col("__w.n"), F.lit(0)),
            "word_chars": F.length(F.regexp_replace(value, SPACE + "+", "")).cast("long"),
            "n_symbols": count("[#*$%&|<>]"),
            "n_dup_lines": F.coalesce(F.col("__l.d"), F.lit(0)),
            "n_repeat_words": F.coalesce(F.col("__w.r"), F.lit(0)),
            "n_lines": F.col("__l.n"),
            "n_capitals": count(r"\p{Lu}"),
            "n_shouts": count("!!"),
            "n_closed_lines": F.col("__l.c"),
        }
    ).drop("__w", "__l")


def fit(patterns: dict[str, int], caps: list[float] | None = None, rounds: int = 100) -> dict[str, float]:
    """Probability of good by vote pattern; ``patterns`` has the number of documents of each.

    Two classes; per rule and class the share of bad votes among its votes, an abstention telling
    nothing. On good documents that share stays near the rule's stated ``false_alarm``, from a quarter of it up: without
    that bound the classes may part along any two rules that agree. Rules start with that bound and
    with ``FIRST_HIT`` on bad documents.
    """
    caps = caps or [r.false_alarm for r in rules()]
    good = {}
    for p in patterns:
        against = [math.log(FIRST_HIT / cap) for v, cap in zip(p, caps, strict=True) if v == BAD and cap < FIRST_HIT]
        good[p] = 1 / (1 + math.exp(sum(against)) / 9)
    for _ in range(rounds):
        share = (sum(n * good[p] for p, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        alarms, hits = [], []
        for j, cap in enumerate(caps):
            rated = [(n, good[p], p[j] == BAD) for p, n in patterns.items() if p[j] != ABSTAIN]
            on_good = sum(n * q for n, q, _ in rated)
            on_bad = sum(n * (1 - q) for n, q, _ in rated)
            alarm = (sum(n * q for n, q, bad in rated if bad) + cap) / (on_good + 1)
            hit = (sum(n * (1 - q) for n, q, bad in rated if bad) + 0.5) / (on_bad + 1)
            alarms.append(min(max(alarm, cap / 4), cap))
            hits.append(min(max(hit, cap), 1 - cap))
        new = {}
        for p in patterns:
            gap = math.log((1 - share) / share)
            for v, alarm, hit in zip(p, alarms, hits, strict=True):
                if v != ABSTAIN:
                    gap += math.log(hit / alarm) if v == BAD else math.log((1 - hit) / (1 - alarm))
            new[p] = 1 / (1 + math.exp(min(gap, 700)))
        moved = max((abs(new[p] - good[p]) for p in patterns), default=0.0)
        good = new
        if moved < 1e-9:
            break
    return good


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(counted: DataFrame, posterior: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, probability of good and kept; ``counted`` has votes."""
    failed = base_failed()
    rows = [F.struct(F.lit(p).alias("votes"), F.lit(q).alias("quality")) for p, q in sorted(posterior.items())]
    spark = counted.sparkSession
    if rows:
        table = spark.range(1).select(F.inline(F.array(*rows)))
    else:
        table = spark.sql("SELECT '' votes, 0.5D quality")
    return (
        counted.drop("quality")
        .join(F.broadcast(table), "votes", "left")
        .withColumns({"base_failed": failed, "kept": ~failed & (F.coalesce("quality", F.lit(0.0)) >= threshold)})
    )


def voted(counted: DataFrame) -> DataFrame:
    return counted.withColumn("votes", F.concat(*[r.vote() for r in rules()]))


def posterior_of(counted: DataFrame) -> dict[str, float]:
    """Fit over all documents; collects one count per vote pattern."""
    return fit({r.votes: r["count"] for r in counted.groupBy("votes").count().collect()})


def quality_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id with counts, votes, probability and verdict; texts are read once."""
    kept = ("doc_id", *MEASURES, *RULE_MEASURES)
    counted = store(voted(measured(docs)).select(*kept, "votes"), "quality")
    return judge(counted, posterior_of(counted), threshold).select(
        "doc_id", *MEASURES, "base_failed", "kept", "votes", "quality"
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns.

    Rows are stored with their votes, so texts are counted once; a filter on the counts themselves
    would be pushed below them and count again.
    """
    row = F.struct(*[F.col(c) for c in docs.columns])
    counted = voted(measured(docs.select("text", row.alias("__row"))))
    stored = store(counted.select("__row", "votes", base_failed().alias("failed")), "quality-votes")
    likely = [votes for votes, quality in sorted(posterior_of(stored).items()) if quality >= threshold]
    return stored.filter(~F.col("failed") & F.col("votes").isin(likely)).select("__row.*")
