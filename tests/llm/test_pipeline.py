import random

import corpus_pipeline
from conftest import FOLDER
from frames import empty, frame

from farelens.llm import langid, minhash_join, weak_quality
from farelens.llm.common import store, table


def test_stages_pass_on_documents(spark):
    docs = table(spark, FOLDER, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = store(stage(spark, docs, FOLDER), name)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        kept.append((docs, after))
        docs = after
    quality, language, near, mix = kept
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    judged = weak_quality.quality_report(quality[0]).filter("kept")
    assert ids(quality[1]) == ids(judged)
    judged = langid.with_language(language[0], langid.fit(language[0])).filter(
        f"lang_pred <> 'und' AND known >= {corpus_pipeline.LEAST_KNOWN}"
    )
    assert ids(language[1]) == ids(judged)
    judged = minhash_join.duplicate_report(near[0], minhash_join.AT_80).filter("kept")
    assert ids(near[1]) == ids(judged)
    assert set(ids(mix[1])) <= set(ids(mix[0]))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(ids(docs))


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_awkward_and_empty_tables(spark):
    for df in (frame(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            df = store(stage(spark, df, FOLDER), name)


def test_text_in_no_learned_language_goes_and_clean_text_stays(spark):
    rng = random.Random(3)
    words = {a: [a + "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 7))) for _ in range(400)] for a in "xyz"}
    rows = [(i, " ".join(rng.choices(words["xyz"[i % 3]], k=rng.randrange(5, 300))), "xyz"[i % 3], "s", 0) for i in range(120)]
    other = [(1000 + i, " ".join("".join(rng.choices("qrstuvw", k=6)) for _ in range(n)), None, "s", 0) for i, n in enumerate((4, 60, 3000))]
    # Half of the words are those of a language: it stays.
    mixed = [(2000, " ".join(w for pair in zip(rng.choices(words["x"], k=80), other[1][1].split() * 2, strict=False) for w in pair), None, "s", 0)]
    stage = dict(corpus_pipeline.STAGES)["identify_language"]
    left = sorted(r.doc_id for r in stage(spark, frame(spark, rows + other + mixed), FOLDER).collect())
    assert left == [*range(120), 2000]


def test_near_duplicates_from_80_percent(spark):
    # Overlapping runs of a sequence: n - s and n + s are the shared and all shingles of a pair s words apart.
    rows, expected = [], []
    for group, (n, apart, linked) in enumerate([(164, 18, True), (164, 17, True), (164, 19, False), (90, 10, True), (90, 11, False)]):
        words = [f"g{group}w{i}" for i in range(n + 4 + 2 * apart)]
        for i in range(3):
            rows.append((10 * group + i, " ".join(words[i * apart : i * apart + n + 4]), "en", "a", 0))
            if i == 0 or not linked:
                expected.append(10 * group + i)
    # One large group, compared in blocks, whose members resemble the first in 80 to 84 of 100.
    base = [f"b{i}" for i in range(204)]
    for i in range(40):
        text = list(base)
        for at in (20 + i, 90, 150, 199 - i // 8)[: i and 4]:
            text[at] = f"new{i}"
        rows.append((1000 + i, " ".join(text), "en", "a", 0))
    stage = dict(corpus_pipeline.STAGES)["drop_near_duplicates"]
    left = sorted(r.doc_id for r in stage(spark, frame(spark, rows), FOLDER).collect())
    expected += [1000]
    assert left == expected == brute_kept(rows, 80)
    assert brute_kept(rows, 85) != expected


def brute_kept(rows, percent):
    """Ids that are the least of their group."""
    sets = [(r[0], {tuple(w[i : i + 5]) for w in [r[1].split()] for i in range(len(w) - 4)}) for r in rows]
    least = {d: d for d, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= percent * len(x | y)]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return sorted(d for d in least if least[d] == d)
