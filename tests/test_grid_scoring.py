"""Scorers that take whole price grids: the user's own, and tree ensembles by breakpoints."""

import sys

import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from farelens.operators import grid_scoring, modelling, pricing, tree_sweep
from farelens.operators.features import BASE_FEATURES, serving_features
from farelens.operators.pricing import price_curve, recommendation, sweep, with_search_range
from farelens.operators.scoring import score_logistic, score_model
from farelens.plans.data import Data
from farelens.plans.pricing_queries import flat_recommendation
from farelens.session import cut_lineage

MODULE = '''
import numpy as np
calls = []
def half(points):
    return np.full(len(points), 0.5)
def short(points):
    return np.full(len(points) - 1, 0.5)
def large(points):
    return np.full(len(points), 1.5)
def missing(points):
    return np.full(len(points), np.nan)
def by_rows(points):
    return [1 / (1 + p / r) for p, r in zip(points["price"], points["reference_price"])]
number = 3
'''


@pytest.fixture(scope="module")
def module(tmp_path_factory):
    folder = tmp_path_factory.mktemp("scorers")
    (folder / "my_scorers.py").write_text(MODULE)
    sys.path.insert(0, str(folder))
    yield str(folder)
    sys.path.remove(str(folder))


def curve_rows(curve):
    columns = ("order_id", "point", "price", "is_valid", "probability", "expected_value", "scan_max", "max_probability", "max_expected_value")
    return sorted(tuple(r) for r in curve.select(*columns).collect())


def close(found, expected):
    assert len(found) == len(expected) > 0
    for a, b in zip(found, expected, strict=True):
        assert a[:2] == b[:2] and a[3] == b[3]
        assert a[2:3] + a[4:] == pytest.approx(b[2:3] + b[4:], rel=1e-12, abs=1e-12)


def test_named_scorer_gives_what_the_built_in_one_gives(spark):
    few = Data(spark, FOLDER).prepared.filter("order_id % 40 < 2")
    named = grid_scoring.score_external("farelens.operators.grid_scoring:logistic")
    close(curve_rows(price_curve(few, named, 20, 30)), curve_rows(price_curve(few, score_logistic(), 20, 30)))


@pytest.mark.parametrize(
    ("name", "error"),
    [
        ("no_such_module:f", ModuleNotFoundError), ("math:no_such_callable", AttributeError), ("math:pi", TypeError),
        ("math", ValueError), (":f", ValueError), ("math:", ValueError),
    ],
)
def test_wrong_names_fail_before_any_job(spark, name, error):
    with pytest.raises(error):
        grid_scoring.score_external(name)
    spark.conf.set(grid_scoring.SCORER_SETTING, name)
    try:
        with pytest.raises(error):
            grid_scoring.configured_scorer(spark)
    finally:
        spark.conf.unset(grid_scoring.SCORER_SETTING)


def test_without_a_setting_the_logistic_score_is_used(spark):
    assert grid_scoring.configured_scorer(spark).inputs == score_logistic().inputs


def score_blocks(name, n=130):
    """A named scorer's curves over plain arrays, several blocks."""
    import pandas as pd

    call = grid_scoring.load_scorer(name)

    def score(orders, prices):
        points = pd.DataFrame({"price": prices.ravel(), "reference_price": np.repeat(orders["reference_price"], prices.shape[1])})
        return np.asarray(call(points), float).reshape(prices.shape)

    frame = pd.DataFrame({"search_min": 50.0 + np.arange(n), "search_max": 300.0 + np.arange(n), "reference_price": 100.0 + np.arange(n), "price_start_local": 120.0 + np.arange(n)})
    (out,) = grid_scoring.curve_function(lambda: score, 10, 20, 0.05)(iter([frame]))
    return frame, out


def test_curves_of_many_blocks(module):
    frame, out = score_blocks("my_scorers:half")
    assert (out["scan_max"] == frame["search_max"]).all() and all((p == 0.5).all() and len(p) == 20 for p in out["probabilities"])
    frame, out = score_blocks("my_scorers:by_rows")
    prices = grid_scoring.price_grid(frame["search_min"].to_numpy(), out["scan_max"].to_numpy(), 20)
    expected = 1 / (1 + prices / frame["reference_price"].to_numpy()[:, None])
    assert np.array_equal(np.stack(out["probabilities"]), expected)
    assert np.array_equal(out["max_probability"], expected.max(axis=1))
    counted = prices >= frame["price_start_local"].to_numpy()[:, None]
    assert np.array_equal(out["max_expected_value"], (prices * expected * counted).max(axis=1))


@pytest.mark.parametrize("name", ["short", "large", "missing"])
def test_wrong_probabilities_are_refused(module, name):
    with pytest.raises(ValueError):
        score_blocks(f"my_scorers:{name}")


def test_no_promising_price_ends_the_scan_at_twice_the_reference():
    import pandas as pd

    frame = pd.DataFrame({"search_min": [50.0], "search_max": [300.0], "reference_price": [100.0], "price_start_local": [90.0]})
    zero = lambda: lambda orders, prices: np.zeros(prices.shape)
    (out,) = grid_scoring.curve_function(zero, 10, 20, 0.05)(iter([frame]))
    assert out["scan_max"].tolist() == [200.0]


def test_empty_batches():
    import pandas as pd

    frame = pd.DataFrame({c: pd.Series(dtype=float) for c in ("search_min", "search_max", "reference_price", "price_start_local")})
    (out,) = grid_scoring.curve_function(lambda: None, 10, 20, 0.05)(iter([frame]))
    assert len(out) == 0


def test_price_columns_are_the_serving_features(spark):
    orders = with_search_range(Data(spark, FOLDER).prepared.filter("order_id % 30 < 2"))
    prices = [0.0, 57.25, 100.0, 133.3, 1234.5]
    at = {p: serving_features(orders.withColumn("price", F.lit(p)), keep=("order_id",)).orderBy("order_id").toPandas() for p in prices}
    base = at[100.0]
    columns = tree_sweep.price_columns(
        {c: base[c].to_numpy() for c in BASE_FEATURES}, np.tile(np.array(prices), (len(base), 1))
    )
    for i, p in enumerate(prices):
        for name in BASE_FEATURES:
            moved = columns[name][:, i] if name in columns else base[name].to_numpy()
            assert np.array_equal(moved, at[p][name].to_numpy()), (name, p)


def random_ensemble(rng, trees=30, depth=4):
    """Trees over a rising, a falling and two fixed features."""
    split, left, right, value, roots, pairs = [], [], [], [], [], {}

    def grow(level):
        at = len(split)
        for x in (split, left, right, value):
            x.append(-1)
        value[at] = float(rng.normal())
        if level and rng.random() < 0.9:
            pair = (int(rng.integers(0, 4)), float(rng.integers(-3, 30)))
            split[at] = pairs.setdefault(pair, len(pairs))
            left[at], right[at] = grow(level - 1), grow(level - 1)
        return at

    for _ in range(trees):
        roots.append(grow(depth))
    found = np.array(list(pairs))
    return tree_sweep.Ensemble(
        ("up", "down", "x", "y"), np.array(roots), np.array(split), np.array(left), np.array(right), np.array(value),
        found[:, 0].astype(int), found[:, 1], 1.0, 0.0,
    )


def test_runs_of_candidates_equal_single_ones():
    rng = np.random.default_rng(4)
    for _ in range(10):
        trees = random_ensemble(rng)
        n, m = 7, 25
        base = rng.integers(-3, 30, (n, 4)).astype(float)
        up = np.sort(rng.integers(-3, 30, (n, m)), axis=1).astype(float)
        down = -np.sort(-rng.integers(-3, 30, (n, m)), axis=1).astype(float)
        down[0] = 5.0  # neither rises nor falls
        got = trees.margins(base, {"up": up, "down": down}, m)
        for row in range(n):
            for i in range(m):
                x, total = (up[row, i], down[row, i], base[row, 2], base[row, 3]), 0.0
                for node in trees.roots:
                    while (s := trees.split[node]) >= 0:
                        goes_left = x[trees.split_feature[s]] <= trees.split_threshold[s]
                        node = trees.left[node] if goes_left else trees.right[node]
                    total += trees.value[node]
                assert got[row, i] == pytest.approx(total, abs=1e-9)


def test_breakpoints_give_what_the_fitted_model_gives(spark):
    d = Data(spark, FOLDER)
    table = cut_lineage(modelling.feature_table(cut_lineage(d.features.select("label", *BASE_FEATURES)), BASE_FEATURES))
    settings = modelling.TreeSettings(iterations=6, depth=5)
    model = modelling.calibrate_sigmoid(modelling.train_classifier(table, settings=settings), table)
    trees = tree_sweep.read_ensemble(spark, model)
    assert len(trees.roots) == 6 and 1 <= trees.depth <= 5
    few = d.prepared.filter("order_id % 20 < 2")
    by_runs, by_rows = tree_sweep.score_trees(spark, model), score_model(model)
    close(curve_rows(price_curve(few, by_runs, 30, 60)), curve_rows(price_curve(few, by_rows, 30, 60)))
    found, expected = (
        sorted(map(tuple, flat_recommendation(recommendation(sweep(few, s, 30, 60))).collect()), key=repr) for s in (by_runs, by_rows)
    )
    assert found == expected


def test_folded_grids_equal_rows_of_candidates(spark):
    """Orders with and without a start price, a distance or a base score, some of them priced at zero."""
    n = F.col("id")
    orders = spark.range(900).select(
        n.alias("order_id"),
        F.when(n % 11 != 0, F.when(n % 13 == 0, 0.0).otherwise(80.0 + n % 97 * 9)).alias("price_start_local"),
        F.when(n % 17 != 0, n * 7919 % 24000).alias("distance_in_meters"),
        (n * 104729 % 3600).alias("duration_in_seconds"),
        F.when(n % 19 != 0, 1.6e9 + n * 5000).cast("bigint").alias("order_timestamp"),
        F.when(n % 23 == 0, -80.0).when(n % 7 == 0, 90.0).otherwise(n % 10 / 10).alias("driver_acceptance_rate"),
    )
    placed, scorer = cut_lineage(orders), score_logistic()
    by_rows, by_grids = pricing._sweep_rows(placed, scorer, 30, 60), sweep(placed, scorer, 30, 60)
    assert set(by_grids.columns) == set(by_rows.columns) and dict(by_grids.dtypes) == dict(by_rows.dtypes)
    names = by_rows.columns
    found, expected = (sorted(map(tuple, x.select(names).collect())) for x in (by_grids, by_rows))
    assert len(found) == len(expected) == 900
    for a, b in zip(found, expected, strict=True):
        assert [x is None for x in a] == [x is None for x in b], (a, b)
        assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None], rel=1e-9, abs=1e-9)


def test_a_sweep_of_grids_makes_no_row_for_a_candidate(spark):
    few = cut_lineage(Data(spark, FOLDER).prepared)
    for scorer in (score_logistic(), grid_scoring.score_external("farelens.operators.grid_scoring:logistic")):
        plan = pricing.recommend_batch(few, scorer)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" not in plan and "Generate posexplode" not in plan
