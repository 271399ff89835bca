"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

A kind of span has a pattern, a validator (Luhn, mod-97, digit counts, part ranges) and a score to
start from. Words close by, out of ``SUPPORT`` and ``AGAINST``, raise or lower that score. Spans of
the base kinds stay whatever their score; the others are added from ``LEAST_SCORE`` on, unless they
overlap a base span.

Everything is row by row and built in: a pattern's hits and the gaps between them come from the same
regular expression, and places are running sums over their lengths, so work grows with the text.
Patterns begin only where a run begins (or where the last hit ended) and repeat possessively; on the
leftmost hits that changes nothing, but a long run is read once and needs no stack.

Defined cases: a null text counts as empty and has no spans; a text of any length is searched whole;
equal rows are judged alike, each on its own; an empty table gives an empty one; other input columns
play no part. Places are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from farelens.llm.common import bind, steps, text_or_empty

BEFORE, AFTER = 40, 20  # characters of context
LEAST_SCORE = 0.6
SUPPORT_WEIGHT, AGAINST_WEIGHT = 0.3, 0.3
BLOCK = 512
# Part of an address up to 255, and doubled digits with their digits summed.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
AGAINST = "(?i)\\b(?:order|invoice|isbn|tracking|serial|sku|hash|checksum|token|version|part no)\\b"
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,base:boolean>>"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    doubled = F.array(*[F.lit(d) for d in DOUBLED])
    values = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(doubled, c.cast("int"))),
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether capitals and digits, their first four moved to the end, leave 1 of 97."""

    def extend(rest: Column, c: Column) -> Column:
        of_letter = (rest * 100 + F.ascii(c) - 55) % 97
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise(of_letter)

    moved = F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4)))
    return F.aggregate(F.split(moved, ""), F.lit(0), extend) == 1


def n_digits(hit: Column, low: int, high: int) -> Column:
    return F.length(digits(hit)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """``score`` is what a confirmed hit starts from; ``base`` kinds stay whatever the words near say."""

    name: str
    rank: int
    pattern: str
    confirmed: Callable[[Column], Column]
    score: Callable[[Column], Column]
    support: str
    base: bool = True


def words_near(*words: str) -> str:
    return "(?i)\\b(?:" + "|".join(words) + ")\\b"


_CARD_WORDS = words_near("card", "credit", "debit", "visa", "mastercard", "amex", "pan", "tarjeta", "carte", "karte")
_PHONE_WORDS = words_near("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "teléfono", "telefon", "téléphone")
_IN_LOCAL = "A-Za-z0-9._%+-"


def _issuer_score(hit: Column) -> Column:
    """Cards whose first digit is one of the issuers' weigh more."""
    return F.when(F.substr(hit, F.lit(1), F.lit(1)).isin("3", "4", "5", "6"), 0.7).otherwise(0.5)


BASE_KINDS = (
    Kind(
        "email", 0, rf"(?:\G|(?<![{_IN_LOCAL}]))[{_IN_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda hit: F.lit(True), lambda hit: F.lit(0.9), words_near("email", "e-mail", "mail", "contact", "correo", "courriel"),
    ),
    Kind(
        "ip", 1, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda hit: hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), lambda hit: F.lit(0.7), words_near("ip", "host", "server", "address", "client"),
    ),
    Kind(
        "card", 2, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
        lambda hit: luhn(digits(hit)), _issuer_score, _CARD_WORDS,
    ),
    Kind(
        "phone", 3, r"\+[0-9][ ().0-9-]+[0-9]",
        lambda hit: n_digits(hit, 9, 15), lambda hit: F.lit(0.7), _PHONE_WORDS,
    ),
)
ADDED_KINDS = (
    # Cards inside a longer chain of digits and spaces, which as a whole is no card.
    Kind(
        "card", 2, r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![A-Za-z0-9])",
        lambda hit: luhn(digits(hit)), _issuer_score, _CARD_WORDS, base=False,
    ),
    # National numbers: digits alone do not tell, words near them must.
    Kind(
        "phone", 3, r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
        lambda hit: F.lit(True), lambda hit: F.lit(0.4), _PHONE_WORDS, base=False,
    ),
    Kind(
        "iban", 4, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
        lambda hit: mod97(F.replace(hit, F.lit(" "), F.lit(""))), lambda hit: F.lit(0.7), words_near("iban", "account", "bank", "cuenta", "compte", "konto"), base=False,
    ),
    Kind(
        "ssn", 5, r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])",
        lambda hit: F.lit(True), lambda hit: F.lit(0.4), words_near("ssn", "social security", "taxpayer"), base=False,
    ),
)


def fold_before(values: Column, start: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """The fold of all values before each place, in blocks, so that a long array is not copied at every step."""

    def before(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), F.slice(F.array(at), 1, 0).alias("out")),
            lambda s, v: F.struct(fold(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )

    blocks = F.transform(
        steps(F.ceil(F.size(values) / BLOCK)), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    )
    return bind(
        blocks,
        lambda cut: F.flatten(
            F.zip_with(cut, before(F.transform(cut, lambda block: F.aggregate(block, start, fold)), start), before)
        ),
    )


def running(lengths: Column) -> Column:
    """Sums of all lengths before each place."""
    return fold_before(lengths, F.lit(0).cast("bigint"), lambda s, n: s + n)


def near_score(kind: Kind, hit: Column, before: Column, after: Column) -> Column:
    """The kind's score of a hit, moved by the words around it, from 0 to 1."""
    around = F.concat(F.right(before, F.lit(BEFORE)), F.lit(" "), F.left(after, F.lit(AFTER)))
    moved = (
        kind.score(hit)
        + F.when(around.rlike(kind.support), SUPPORT_WEIGHT).otherwise(0.0)
        - F.when(around.rlike(AGAINST), AGAINST_WEIGHT).otherwise(0.0)
    )
    return F.round(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)), 6)


def found(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind: leftmost, without overlaps, a hit that fails is passed over."""

    def placed(cut: Column) -> Column:
        hits, gaps = cut["hits"], cut["gaps"]
        lengths = F.transform(
            hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("bigint")
        )
        return bind(
            running(lengths),
            lambda before: F.filter(
                F.transform(
                    hits,
                    lambda h, i: F.when(
                        kind.confirmed(h),
                        F.struct(
                            (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
                            F.lit(kind.rank).alias("rank"),
                            (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
                            F.lit(kind.name).alias("kind"),
                            near_score(kind, h, F.get(gaps, i), F.get(gaps, i + 1)).alias("score"),
                            F.lit(kind.base).alias("base"),
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )

    cut = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"),
        F.split(text, kind.pattern, -1).alias("gaps"),
    )
    return F.when(text.rlike(kind.pattern), bind(cut, placed)).otherwise(F.array().cast(SPANS))


def without_overlaps(base: Column, added: Column) -> Column:
    """Base spans and those added ones that overlap none of them, by start, then kind."""
    # In the order of their starts, the base spans before one reach furthest, those behind begin first.
    reach = F.lit(-1).cast("bigint")
    beyond = F.lit(1 << 62).cast("bigint")

    def judged(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(reach))
        starts = F.transform(F.reverse(spans), lambda s: F.when(s["base"], s["start"]).otherwise(beyond))
        limits = F.struct(
            fold_before(ends, reach, lambda m, v: F.greatest(m, v)).alias("reached"),
            F.reverse(fold_before(starts, beyond, lambda m, v: F.least(m, v))).alias("next"),
        )
        return bind(
            limits,
            lambda at: F.filter(
                spans,
                lambda s, i: s["base"] | ((F.get(at["reached"], i) <= s["start"]) & (F.get(at["next"], i) >= s["end"])),
            ),
        )

    merged = bind(F.array_sort(F.concat(base, added)), judged)
    return F.when(F.size(added) == 0, F.array_sort(base)).when(F.size(base) == 0, F.array_sort(added)).otherwise(merged)


def with_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """Add ``spans``: by start, then kind, with kind, score and whether it is a base span."""
    text = text_or_empty(column)
    base = F.concat(*[found(text, k) for k in BASE_KINDS])
    proposed = F.concat(*[found(text, k) for k in ADDED_KINDS])
    both = F.struct(base.alias("base"), F.filter(proposed, lambda s: s["score"] >= LEAST_SCORE).alias("added"))
    return docs.withColumn("spans", bind(both, lambda b: without_overlaps(b["base"], b["added"])))


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def personal_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of base spans, and all spans, of every document (doc_id, text)."""
    # Spans are made once, not once for each column that looks at them.
    judged = with_spans(docs.select("doc_id", "text")).select("doc_id", F.explode(F.array("spans")).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: Kind) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind.name)).cast("bigint").alias(f"n_{kind.name}")

    least = F.array_min(F.transform("spans", lambda s: s["score"]))
    return judged.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"),
        least.alias("least_score"),
    )
