import hashlib
import random
import struct

import xxhash
from frames import clashing, documents, empty, fold, frame

from farelens.llm import winnowing
from farelens.llm.common import text_or_empty


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def brute(text, k=5, window=4):
    """The same fingerprint, window by window."""
    units = []
    for word in fold(text).replace("\x0b", " ").replace("\x0c", " ").split():
        units += [word[i : i + 16] for i in range(0, len(word), 16)]
    hashes = [signed(xxhash.xxh64_intdigest(u.encode(), seed=42)) for u in units]
    if not hashes:
        return []
    if len(hashes) < k:
        return [(signed(xxhash.xxh64_intdigest(",".join(map(str, hashes)).encode(), seed=42)), 0)]
    grams = []
    for i in range(len(hashes) - k + 1):
        seed = 42
        for h in hashes[i : i + k]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=seed)
        grams.append(signed(seed))
    chosen = []
    for i in range(max(len(grams) - window + 1, 1)):
        part = range(i, min(i + window, len(grams)))
        best = min(part, key=lambda j: (grams[j] >> winnowing.PLACE_BITS, -j))
        if (grams[best], best) not in chosen[-1:]:
            chosen.append((grams[best], best))
    return chosen


def prints(df):
    return [(r.text, [(x["hash"], x.place) for x in r.fingerprint]) for r in winnowing.with_fingerprint(df).collect()]


def test_equals_brute_force(spark):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 50_000]
    rows += [(50, "a a a a a a a a a a a a", None, None, 0)]  # all ties
    for text, got in prints(frame(spark, rows)):
        assert got == brute(text or "")


def test_rightmost_of_equal_hashes(spark):
    [(_, got)] = prints(frame(spark, [(1, "a " * 12, None, None, 0)]))
    assert [place for _, place in got] == [3, 4, 5, 6, 7]


def test_shared_run_is_found(spark):
    run = "q1 q2 q3 q4 q5 q6 q7 q8"
    texts = [f"{'x ' * n} u{n} {run} v{n} {'y ' * n}" for n in range(12)]
    got = [{h for h, _ in f} for _, f in prints(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]))]
    assert all(a & b for a in got for b in got)


def test_report(spark):
    rows = documents()
    out = winnowing.fingerprint_report(clashing(spark)).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = []
    for i, (doc, text, *_) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        expected.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], key=key) == sorted(expected, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    by_id = {r.doc_id: r for r in out}
    assert by_id[0].fingerprint == by_id[1].fingerprint
    assert by_id[1].near_next == 1 and by_id[2].near_next > 0.7  # next of 1 is 0, of 2 is 1
    assert 0.3 < by_id[None].near_edited < 0.7


def test_many_blocks_follow_each_other(spark):
    rows = [(i * 7 % 1009 - 500, f"text {i} and more words here {i * 3}", None, None, 0) for i in range(1009)]
    out = {r.doc_id: r.edited_sha256 for r in winnowing.fingerprint_report(frame(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows}
    for doc, text in texts.items():
        following = texts[doc - 1] if doc - 1 in texts else texts[max(texts)]
        third = len(text) // 3
        assert out[doc] == hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()


def test_a_hot_id_is_cut_by_its_texts(spark, monkeypatch):
    """Most rows have no id: every row still has one follower, and no block holds more than its part."""
    monkeypatch.setattr(winnowing, "LEAST_BLOCK_ROWS", 20)
    texts = [f"{i} text {i * i} of some {i % 7} words" for i in range(600)]
    rows = [(None if i % 3 else i, t, None, None, 0) for i, t in enumerate(texts)]
    rows += [(None, "the same text for many rows", None, None, 0)] * 30
    df = frame(spark, rows).select("doc_id", "text")
    chained = winnowing.with_next(df, ["text"])
    placed = chained.withColumn("next", winnowing.successor(chained["text"], "text")).filter("NOT __guest").collect()
    sizes = {}
    for r in placed:
        sizes[r["__block"]] = sizes.get(r["__block"], 0) + 1
    assert len(placed) == len(rows) and len(sizes) > 20 and max(sizes.values()) < 80
    follower = {}
    for r in placed:
        follower.setdefault((r.doc_id, r.text), []).append(r.next)
    named = sorted((r[0], r[1]) for r in rows if r[0] is not None)
    for (_, lower), pair in zip(named, named[1:], strict=False):
        assert follower[pair] == [lower]
    assert sorted(n for f in follower.values() for n in f) == sorted(r[1] for r in rows)  # one ring
    unnamed = [f for (d, _), f in follower.items() if d is None]
    assert sum(n == named[-1][1] for f in unnamed for n in f) == 1  # the last without an id, by the first of all


def test_one_row_and_none(spark):
    [r] = winnowing.fingerprint_report(frame(spark, [(1, "a b c", None, None, 5)])).collect()
    assert r.near_next == 1.0
    assert winnowing.fingerprint_report(empty(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = winnowing.with_fingerprint(frame(spark).select(text_or_empty().alias("text")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def cut(run):
    """Pieces of a long run, window by window."""
    local = [xxhash_of(run[i : i + 4]) >> winnowing.PLACE_BITS for i in range(len(run) - 3)]
    starts = {0} | {min(range(i, i + 13), key=lambda j: (local[j], -j)) for i in range(len(local) - 12)}
    ends = sorted(starts)[1:] + [len(run)]
    return [run[a:b] for a, b in zip(sorted(starts), ends, strict=True)]


def xxhash_of(chars):
    seed = 42
    for c in chars:
        seed = xxhash.xxh64_intdigest(c.encode(), seed=seed)
    return signed(seed)


def test_long_runs_are_cut_by_their_characters(spark):
    rng = random.Random(5)
    some = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    shared, passage = some(2000), some(150)
    changed = shared[:1000] + "x" + shared[1000:]
    texts = [shared, "x" + shared, some(5) + " " + shared + some(3), changed]
    texts += [some(37 + 3 * i) + passage + some(50 - 2 * i) for i in range(8)]
    texts += ["a" * 17, "ab" * 40, "one " + some(17) + " two " + some(16), "😀" * 9 + some(20)]
    df = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = df.select("text", winnowing.units(text_or_empty()).alias("u")).collect()
    for text, units in got:
        expected = [p for r in text.split() for p in (cut(r) if len(r) > 16 else [r])]
        assert units == expected and max(map(len, units)) <= 16
    sets = {t: {h for h, _ in f} for t, f in prints(df)}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(texts[0], texts[1]) > 0.95 and alike(texts[0], texts[2]) > 0.9 and alike(texts[0], changed) > 0.9
    assert all(sets[a] & sets[b] for a in texts[4:12] for b in texts[4:12])
