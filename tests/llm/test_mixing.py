import pytest
from conftest import FOLDER
from frames import clashing, documents, empty, frame, words

from farelens.llm import mixing
from farelens.llm.common import table


def pour(sizes, weights, epochs):
    """Share by weight, clamp, share the rest again."""
    named = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(named)}
    size, total = dict(named), sum(n for _, n in named)
    fixed = {}
    while True:
        free = [s for s in size if s not in fixed]
        rest = total - sum(fixed.values())
        now = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if now[s] > epochs * size[s]]
        if not over:
            return fixed | now
        fixed |= {s: epochs * size[s] for s in over}


@pytest.mark.parametrize(
    "sizes",
    [
        [("a", 10), ("b", 1000), (None, 5)],
        [("a", 1), ("b", 1), ("c", 1), ("d", 9000)],
        [("x", 50)],
        [("a", 0), ("b", 10)],
        [(f"s{i}", (i * 37) % 101 + 1) for i in range(40)],
    ],
)
def test_targets(sizes):
    got = {s.source: s.target for s in mixing.water_fill(sizes, (5, 2, 1), 3)}
    assert got == pytest.approx(pour(sizes, (5, 2, 1), 3))
    assert sum(got.values()) == pytest.approx(sum(n for _, n in sizes))


def test_mix_is_near_its_targets(spark):
    rows = mixing.mix_report(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    target, taken = {}, {}
    for r in rows:
        key = (r.source_size, r.target)
        target[key], taken[key] = r.target, taken.get(key, 0) + r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for key, goal in target.items():
        assert abs(taken[key] - goal) <= 0.06 * goal
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.01 * sum(target.values())


def test_reruns_agree(spark):
    docs = table(spark, FOLDER, "documents")
    a, b = ({tuple(r) for r in mixing.mix_report(df).collect()} for df in (docs, docs.repartition(3)))
    assert a == b


def test_awkward_rows(spark):
    rows = documents()
    df = clashing(spark)
    mixed = mixing.mix(df)
    assert set(df.columns) <= set(mixed.columns)
    out = mixed.collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    goals = pour(list(sizes.items()), (5, 2, 1), 3)
    for r in out:
        assert r["size"] == len(words(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source]) and r.taken == r["size"] * r.repeats <= 3 * r["size"]
    times = mixing.repeated(mixed).count()
    assert times == sum(r.repeats for r in out)


def test_empty_table(spark):
    assert mixing.mix_report(empty(spark)).count() == 0
    assert mixing.mix_report(frame(spark, [(1, None, None, None, 0)])).collect()[0].taken == 0
