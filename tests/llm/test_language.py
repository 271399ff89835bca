import zlib

import numpy as np
import pyarrow as pa
import pytest
from frames import clashing, documents, empty, frame

from farelens.llm import langid
from farelens.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.language_report(docs).collect() if r.held_out and truth[r.doc_id]]
    right = sum(r.lang_pred == truth[r.doc_id] for r in rows)
    assert len(rows) > 100 and right >= 0.97 * len(rows)


def test_awkward_rows(spark):
    rows = documents()
    out = langid.language_report(clashing(spark)).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for doc in (3, 4, 5, 12):
        assert (by_id[doc].lang_pred, by_id[doc].score) == ("und", 0.0)
    assert all(r.lang_pred in ("de", "en", "fr", "und") and 0 <= r.score <= 1 for r in out)
    for r in out:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 4 == 2)


def test_prediction_sees_only_the_text(spark):
    rows = documents()
    model = langid.fit(frame(spark))
    swapped = [(1000 + i, r[1], "xx", "yy", 0) for i, r in enumerate(rows)]
    plain = [r.lang_pred for r in langid.with_language(frame(spark, rows).coalesce(1), model).collect()]
    other = [r.lang_pred for r in langid.with_language(frame(spark, swapped).coalesce(1), model).collect()]
    assert plain == other


def table_of(frequencies, languages=("a", "b"), floor=0.0):
    """A table with the given frequencies by language."""
    start = np.arange(len(frequencies) + 1) * len(languages)
    gains = np.log(np.array(list(frequencies.values()), float)).ravel() - floor
    lang = np.tile(np.arange(len(languages)), len(frequencies)).astype(np.int32)
    return langid.Table(pa.array(list(frequencies), pa.string()), start, lang, gains, np.full(len(languages), floor))


NOTHING = table_of({})


def test_backoff_goes_from_long_to_short():
    grams = (table_of({"z": (0.2, 0.8)}, floor=-1.0), table_of({"^q": (0.7, 0.3)}), NOTHING, NOTHING, NOTHING)
    model = langid.Model(("a", "b"), table_of({"known": (0.9, 0.1)}, floor=-3.0), grams, np.array([5.0, 6.0]))
    scorer = langid.Scorer(model)
    assert scorer.score("KNOWN")[0] == "a"
    assert scorer.score("qxz")[0] == "a"  # its 2-gram, not its character
    assert scorer.score("xz")[0] == "b"
    assert scorer.score("yyy") == ("b", pytest.approx(6 / 11), 0.0)  # nothing known: the language with the most words
    assert scorer.score("known known qxz")[1] > scorer.score("known")[1]
    assert scorer.score("known known qxz yyy")[2] == 0.5


def test_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(langid, "CACHED_BYTES", 10 * 2 * 8)
    model = langid.Model(("a", "b"), table_of({"w": (0.6, 0.4)}), (NOTHING,) * 5, np.array([1.0, 1.0]))
    scorer = langid.Scorer(model)
    for i in range(50):
        assert scorer.score(" ".join(["w"] + [f"{chr(97 + i % 26)}{'x' * j}" for j in range(8)]))[0] == "a"
    assert len(scorer.cached) <= 10
    assert scorer.score(" ".join(["w"] + ["x" * j for j in range(1, 40)]))[0] == "a"  # more unseen words than the cache holds


def brute(docs, texts):
    """(language, share, known) of texts, by dictionaries over all words and runs of ``docs``."""
    import math
    from collections import Counter, defaultdict

    counts = [defaultdict(Counter) for _ in range(6)]
    for lang, text in docs:
        for word in langid.LETTERS.findall(text.lower()):
            counts[0][lang][word] += 1
            for k in range(1, 6):
                for gram in langid.grams_of(word, k):
                    counts[k][lang][gram] += 1
    languages = sorted(counts[0])
    sizes = [len(set().union(*by.values())) for by in counts]

    def logs(key, k):
        return [math.log((counts[k][a][key] + 0.5) / (sum(counts[k][a].values()) + 0.5 * (sizes[k] + 1))) for a in languages]

    out = []
    for text in texts:
        words = langid.LETTERS.findall((text or "").lower())
        sums = [0.0] * len(languages)
        for word in words:
            adds = [logs(word, 0)] if any(counts[0][a][word] for a in languages) else []
            for k in range(5, 0, -1):
                adds = adds or [logs(g, k) for g in langid.grams_of(word, k) if any(counts[k][a][g] for a in languages)]
            for i in range(len(languages)):
                sums[i] += sum(x[i] for x in adds) / max(len(adds), 1)
        if not words or not languages:
            out.append(("und", 0.0, 0.0))
            continue
        if not any(sums):
            sums = [math.log(sum(counts[0][a].values())) for a in languages]
        best = max(range(len(languages)), key=lambda i: (sums[i], -i))
        known = sum(counts[0][languages[best]][w] > 0 for w in words) / len(words)
        out.append((languages[best], 1 / sum(math.exp(x - sums[best]) for x in sums), known))
    return out


def test_equals_brute_force(spark):
    docs = [(r.lang, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    docs = [(a, t[:1500]) for a, t in docs if a and t]
    docs += [(f"rare{i}", f"selten{i} wort{chr(97 + i)} हिन्दी") for i in range(12)]
    texts = [t[::3] for _, t in docs[:15]] + [r[1] and r[1][:3000] for r in documents()]
    texts += ["selten3 wortd", "हिन्दी में", "½ ² Ⅷ ①", "Ünïcode ﬁ ʻokina", "日本語 ok"]
    model = langid.fit(frame(spark, [(i, t, a, None, 0) for i, (a, t) in enumerate(docs)]))
    found = langid.with_language(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model)
    got = {r.doc_id: (r.lang_pred, r.score, r.known) for r in found.collect()}
    for i, expected in enumerate(brute(docs, texts)):
        assert got[i] == (expected[0], pytest.approx(expected[1], abs=1e-6), pytest.approx(expected[2])), texts[i]


def test_letters_are_letters():
    assert langid.letter_runs("½ ² Ⅷ ① 12 _") == []
    assert langid.letter_runs("हिन्दी Ab½cd éÉ x²") == ["हिन्दी", "ab", "cd", "éé", "x"]
    every = "".join(chr(c) for c in range(0x250))
    assert langid.NEAR_LETTERS.findall(every) == langid.LETTERS.findall(every)


def test_every_language_of_the_sample_can_be_predicted(spark):
    docs = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "abcdefgh"), f"l{i:03}", None, 0) for i in range(600)]
    out = langid.with_language(frame(spark, docs), langid.fit(frame(spark, docs))).collect()
    assert all(r.lang_pred == r.lang and r.known == 1.0 for r in out)


def test_nothing_to_learn_from(spark):
    assert langid.language_report(empty(spark)).count() == 0
    [r] = langid.language_report(frame(spark, [(1, "some text", None, None, 9)])).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)
