"""Language identification by words first, and shorter and shorter character runs for unseen words.

A known word adds its log frequency in each language. An unseen one adds the mean log frequency of
its character 5-grams, if any of them is known, else of its 4-grams, and so on down to single
characters. The language with the largest sum wins; its share among all is the score. ``known`` is the
share of the text's words that training texts of that language have.

The model is fitted on a bounded sample: ``SAMPLE`` documents per language in the mean, picked by a
digest; every language and every word and character run of the sample is kept. A key holds only the
languages it occurs in, so the model is as large as the sample has (key, language) pairs. It is
broadcast; whole texts are scored where they lie, without a shuffle. Sums of unseen words are cached
per worker, up to ``CACHED_BYTES``.

Words are runs of letters and the marks on them. Defined cases: a null text, or one without a letter,
is ``und`` with score 0; so is every text if nothing could be learned; a text with no known word or
character gets the language with the most training words, of equal sums the first by name; languages
that are null are not learned from; repeated rows are judged alike; a text of any length is read
whole; input columns with the names of the results are replaced, all others kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from farelens.llm.common import store

SAMPLE = 2500
LONGEST = 5
CACHED_BYTES = 16_000_000
UNDETERMINED = "und"
# Up to U+024F the letters are these; beyond, a general pattern finds letters with their marks.
NEAR_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")
FAR = re.compile("[ɐ-\U0010ffff]")
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SHARES = 1 << 20


@dataclass(frozen=True)
class Table:
    """Log frequencies of keys by language: those of a key's own languages, and one for all the others.

    Key r has the languages ``lang[start[r]:start[r + 1]]``, whose log frequencies lie ``gain`` above
    ``floor``, that of a key that a language does not have. Columns go from the driver to the workers
    as they are; only there keys become Python strings.
    """

    keys: pa.Array
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    @cached_property
    def rows(self) -> dict[str, int]:
        return {key: i for i, key in enumerate(self.keys.to_pylist())}

    def gains(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and gains of rows ``at``, one behind the other."""
        first, sizes = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.cumsum(sizes)
        places = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.lang[places], self.gain[places]

    def total(self, at: np.ndarray) -> np.ndarray:
        """Sum of the log frequencies of rows ``at``, by language."""
        lang, gain = self.gains(at)
        return len(at) * self.floor + np.bincount(lang, gain, len(self.floor))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    words: Table
    grams: tuple[Table, ...]  # by length, from 1
    prior: np.ndarray  # training words by language


def letter_runs(text: str) -> list[str]:
    folded = text.lower()
    return (LETTERS if FAR.search(folded) else NEAR_LETTERS).findall(folded)


def grams_of(word: str, length: int) -> list[str]:
    edged = f"^{word}$" if length > 1 else word
    return [edged[i : i + length] for i in range(len(edged) - length + 1)]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in batches:
        counts: Counter = Counter()
        for lang, text in zip(docs["lang"], docs["text"], strict=True):
            for word, n in Counter(letter_runs(text)).items():
                counts[lang, word] += n
        yield pd.DataFrame([(a, w, n) for (a, w), n in counts.items()], columns=["lang", "word", "n"])


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for words in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(words["lang"], words["word"], words["n"], strict=True):
            for length in range(1, LONGEST + 1):
                for g in grams_of(word, length):
                    counts[lang, length, g] += n
        yield pd.DataFrame([(a, k, g, n) for (a, k, g), n in counts.items()], columns=["lang", "length", "gram", "n"])


def sampled(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """About ``per_language`` documents of each language; all of a language that has fewer."""
    usable = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each class of the model
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SHARES)) / F.lit(_SHARES)
    return usable.join(F.broadcast(sizes), "lang").filter(share < F.lit(per_language) / F.col("n")).select("lang", "text")


def key_table(counts: DataFrame, languages: tuple[str, ...]) -> Table:
    """Smoothed log frequencies out of (key, lang, n) rows, a row for each pair; bounded by the sample."""
    found = counts.select("key", "lang", "n").orderBy("key", "lang").toArrow().combine_chunks()
    keys = found["key"].combine_chunks() if found.num_rows else pa.array([], pa.string())
    lang = pc.index_in(found["lang"], pa.array(languages, pa.string())).to_numpy()
    n = found["n"].to_numpy().astype(np.float64)
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    spread = np.bincount(lang, n, len(languages)) + 0.5 * (len(first) + 1)
    return Table(
        keys=keys.filter(pa.array(new)),
        start=np.append(first, len(keys)),
        lang=lang.astype(np.int32),
        gain=np.log((n + 0.5) / 0.5),
        floor=np.log(0.5 / spread),
    )


def fit(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """A model from text and lang of ``docs``."""
    counted = sampled(docs, per_language).mapInPandas(_count_words, "lang string, word string, n long")
    words = store(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    grams = store(
        words.mapInPandas(_count_grams, "lang string, length int, gram string, n long")
        .groupBy("lang", "length", "gram")
        .agg(F.sum("n").alias("n")),
        "language-grams",
    )
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(totals))
    by_length = (grams.filter(F.col("length") == k).withColumnRenamed("gram", "key") for k in range(1, LONGEST + 1))
    return Model(
        languages,
        key_table(words.withColumnRenamed("word", "key"), languages),
        tuple(key_table(g, languages) for g in by_length),
        np.array([totals[a] for a in languages], np.float64),
    )


class Scorer:
    """Sums of log frequencies of texts; those of unseen words are cached as rows behind the known ones."""

    def __init__(self, model: Model):
        self.model = model
        self.known = len(model.words.keys)
        width = max(len(model.languages), 1)
        self.most = max(CACHED_BYTES // (8 * width), 1)
        self.values = np.zeros((min(self.most, 1024), width))
        self.cached: dict[str, int] = {}

    def unseen(self, word: str) -> np.ndarray | float:
        for table, length in zip(reversed(self.model.grams), range(LONGEST, 0, -1), strict=True):
            at = [table.rows[g] for g in grams_of(word, length) if g in table.rows]
            if at:
                return table.total(np.array(at)) / len(at)
        return 0.0

    def learn(self, words: set[str]) -> None:
        need = len(self.cached) + len(words)
        if need > len(self.values):
            grown = np.zeros((max(need, min(self.most, 2 * len(self.values))), self.values.shape[1]))
            grown[: len(self.values)] = self.values
            self.values = grown
        for word in words:
            self.values[len(self.cached)] = self.unseen(word)
            self.cached[word] = self.known + len(self.cached)

    def places(self, words: list[str]) -> np.ndarray:
        """Known words by their row, others by their row in the cache behind those."""
        rows = self.model.words.rows
        at = [rows.get(w, -1) for w in words]
        gaps = [i for i, row in enumerate(at) if row < 0]
        if gaps:
            own = {words[i] for i in gaps}
            if not own <= self.cached.keys():
                if len(self.cached) + len(own) > self.most:
                    self.cached = {}
                self.learn(own.difference(self.cached))
            for i in gaps:
                at[i] = self.cached[words[i]]
        return np.array(at, np.int64)

    def score(self, text: str | None) -> tuple[str, float, float]:
        words = letter_runs(text) if text else []
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0, 0.0
        at = self.places(words)
        seen = at[at < self.known]
        lang, gain = self.model.words.gains(seen)
        sums = len(seen) * self.model.words.floor + np.bincount(lang, gain, len(self.model.languages))
        sums = sums + self.values[at[at >= self.known] - self.known].sum(axis=0)
        if not sums.any():
            sums = np.log(self.model.prior)
        best = int(np.argmax(sums))
        share = float(1 / np.exp(sums - sums[best]).sum())
        return self.model.languages[best], share, float((lang == best).sum() / len(words))


def identified(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct<lang_pred, score, known> of a text column of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for texts in batches:
            yield pd.DataFrame([scorer.score(t) for t in texts], columns=["lang_pred", "score", "known"])

    return F.pandas_udf(run, "lang_pred string, score double, known double")(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model is fitted on: checksum of the id, remainder 2 of 4."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % 4 == 2


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and known."""
    found = docs.withColumn("__found", identified(docs, model))
    return found.withColumns({c: F.col(f"__found.{c}") for c in ("lang_pred", "score", "known")}).drop("__found")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents, by a model of those not held out."""
    texts = docs.select("doc_id", "text", "lang")
    model = fit(texts.filter(~held_out()))
    judged = with_language(texts.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "known")
