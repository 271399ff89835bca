"""Scorers that take all candidate prices of an order in one call, outside generated code.

A grid scorer gets a block of orders and an array of prices, a row for each order, and returns the
probabilities in the same shape. It is loaded once per worker and called from an Arrow-batched
function, which finds the scan limit on the coarse prices, then scores the fine ones: every candidate
is scored once. What comes back is one array per order (``with_curves``), or the array folded into the
order's optimum and the sums of its zones (``with_sweep``): then no candidate ever becomes a row.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from farelens.operators.history import DRIVER, USER
from farelens.operators.scoring import Scorer, score_logistic
from farelens.schema import ORDER_FIELDS

GridFunction = Callable[[pd.DataFrame, np.ndarray], np.ndarray]
CURVE = ("scan_max", "probabilities", "max_probability", "max_expected_value")
CURVE_DDL = "scan_max double, probabilities array<double>, max_probability double, max_expected_value double"
# What ``with_sweep`` adds: these, and for each zone the count, extreme prices and sums over its valid prices.
SWEPT = (
    "scan_max", "max_probability", "max_expected_value", "optimal_price", "optimal_probability",
    "max_probability_price",
)
ZONE_SUMS = ("n", "min", "max", "p", "ev")
# Orders that are scored together; a thousand candidate prices of each are in memory.
BLOCK_ORDERS = 64
# Session setting that names the scorer, as module:callable.
SCORER_SETTING = "farelens.scorer"


@dataclass(frozen=True)
class GridScorer:
    """``load`` runs in the worker and returns the function; ``inputs`` are the columns it looks at.

    ``prepare`` works once per order, before. The reference price is always among the inputs.
    """

    inputs: tuple[str, ...]
    load: Callable[[], GridFunction]
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda orders: orders)


def price_grid(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Evenly spaced prices, a row for each order, by the arithmetic of ``pricing.grid_price``."""
    step = (high - low) / float(n - 1)
    prices = low[:, None] + np.arange(n) * step[:, None]
    prices[:, -1] = high
    return prices


def checked(probabilities: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    found = np.asarray(probabilities, dtype=np.float64)
    if found.shape != shape:
        raise ValueError(f"a scorer returned {found.shape} probabilities for {shape} prices")
    if not ((found >= 0) & (found <= 1)).all():
        raise ValueError("a scorer returned a probability that is missing or not between 0 and 1")
    return found


def as_numbers(probabilities: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.broadcast_to(probabilities, shape)


@dataclass(frozen=True)
class GridRules:
    """How candidate prices are scanned, weighed and put into zones."""

    coarse: int
    fine: int
    least: float  # probability up to which the scan goes
    weights: tuple[float, float] = (0.0, 0.0)  # of normalized expected value and normalized probability
    zones: tuple[tuple[int, float, float], ...] = ()  # id, lowest probability, probability just above


def highest_where(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The largest value of each row where the mask holds; NaN where there is none."""
    top = np.where(mask & ~np.isnan(values), values, -np.inf).max(axis=1)
    return np.where(np.isneginf(top), np.nan, top)


def scan_block(score: GridFunction, block: pd.DataFrame, rules: GridRules, check: Callable):
    """Scan limits of a block of orders, with the prices, probabilities and validity of fine candidates."""
    low, high, reference, start = (
        block[c].to_numpy(np.float64) for c in ("search_min", "search_max", "reference_price", "price_start_local")
    )
    prices = price_grid(low, high, rules.coarse)
    promising = check(score(block, prices), prices.shape) >= rules.least
    top = highest_where(promising, prices)
    limit = np.where(np.isnan(top), reference * 2.0, top)
    prices = price_grid(low, limit, rules.fine)
    found = check(score(block, prices), prices.shape)
    # Prices below the user's own do not count, unless the scan ends below it.
    valid = (prices >= start[:, None]) | ~(limit >= start)[:, None]
    return limit, prices, found, valid


def curve_function(load: Callable[[], GridFunction], coarse: int, fine: int, least: float):
    """Arrow batches of orders to their scan limit, fine probabilities and the maxima of these."""
    rules = GridRules(coarse, fine, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for orders in batches:
            limits, curves, highest, worth = [], [], [], []
            for at in range(0, len(orders), BLOCK_ORDERS):
                block = orders.iloc[at : at + BLOCK_ORDERS].reset_index(drop=True)
                limit, prices, found, valid = scan_block(score, block, rules, checked)
                limits.append(limit)
                curves += list(found)
                highest.append(found.max(axis=1))
                worth.append(np.where(valid, prices * found, -np.inf).max(axis=1))
            whole = (np.concatenate(x) if x else np.empty(0) for x in (limits, highest, worth))
            limit, top, best = whole
            yield pd.DataFrame(dict(zip(CURVE, (limit, curves, top, best), strict=True)))

    return run


def swept_columns(rules: GridRules) -> tuple[str, ...]:
    per_zone = [f"z{zone}_{name}" for zone, *_ in rules.zones for name in ZONE_SUMS]
    return (*SWEPT, *per_zone)


def fold_block(limit: np.ndarray, prices: np.ndarray, p: np.ndarray, valid: np.ndarray, rules: GridRules) -> dict:
    """The optimum, the likeliest price and the sums of each zone, by the arithmetic of ``pricing.price_curve``.

    NaN stands for what is missing.
    """
    worth = prices * p
    highest, best_worth = highest_where(np.True_, p), highest_where(valid, worth)
    top = highest[:, None]
    normalized = np.where(top > 0, p / np.where(top > 0, top, 1.0), p)
    divisor = np.where(best_worth == 0, np.nan, best_worth)[:, None]
    value, chance = rules.weights
    weighted = worth / divisor * value + normalized * chance

    def first_highest(values: np.ndarray) -> np.ndarray:
        """Place of the highest valid value, to nine decimals, and of the lowest price among equals."""
        units = np.floor(values * 1e9 + 0.5)
        units = np.where(np.isnan(units), -1.0, units)
        return np.where(valid, units, -np.inf).argmax(axis=1)

    rows = np.arange(len(prices))
    best, likeliest = first_highest(weighted), first_highest(p)
    numbers = (limit, highest, best_worth, prices[rows, best], p[rows, best], prices[rows, likeliest])
    out = dict(zip(SWEPT, numbers, strict=True))
    for zone, low, high in rules.zones:
        held = valid & (p >= low) & (p < high)
        n = held.sum(axis=1)
        none = n == 0
        lowest = np.where(held, prices, np.inf).min(axis=1)
        largest = np.where(held, prices, -np.inf).max(axis=1)
        sums = (np.where(held, x, 0.0).sum(axis=1) for x in (p, worth))
        values = [np.where(none, np.nan, x) for x in (lowest, largest, *sums)]
        out |= dict(zip((f"z{zone}_{name}" for name in ZONE_SUMS), (n, *values), strict=True))
    return out


def sweep_function(load: Callable[[], GridFunction], rules: GridRules, check: Callable):
    """Arrow batches of orders to one row of ``swept_columns`` each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for orders in batches:
            folded = []
            for at in range(0, len(orders), BLOCK_ORDERS):
                block = orders.iloc[at : at + BLOCK_ORDERS].reset_index(drop=True)
                with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                    folded.append(fold_block(*scan_block(score, block, rules, check), rules))
            names = swept_columns(rules)
            yield pd.DataFrame({c: np.concatenate([f[c] for f in folded]) if folded else [] for c in names})

    return run


def with_curves(ranged: DataFrame, scorer: GridScorer, coarse: int, fine: int, least: float) -> DataFrame:
    """Add the columns of ``CURVE``, over the fine prices, to orders that have their search range."""
    run = curve_function(scorer.load, coarse, fine, least)

    @F.pandas_udf(CURVE_DDL)
    def curve(orders: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run(orders)

    needed = dict.fromkeys(("search_min", "search_max", "reference_price", "price_start_local", *scorer.inputs))
    curved = ranged.withColumn("_curve", curve(F.struct(*needed)))
    return curved.select(*ranged.columns, *[f"_curve.{c}" for c in CURVE])


def with_sweep(ranged: DataFrame, scorer: Scorer | GridScorer, rules: GridRules) -> DataFrame:
    """Add ``swept_columns`` to orders that have their search range; candidates stay within the function.

    A scorer of the user's own must give every probability. A built-in one that also scores grids gives
    NaN where an order lacks a value, as its columns give null.
    """
    own = isinstance(scorer, GridScorer)
    run = sweep_function(scorer.load if own else scorer.grid, rules, checked if own else as_numbers)
    names = swept_columns(rules)
    ddl = ", ".join(f"{c} {'bigint' if c.endswith('_n') else 'double'}" for c in names)

    @F.pandas_udf(ddl)
    def fold(orders: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run(orders)

    needed = dict.fromkeys(("search_min", "search_max", "reference_price", "price_start_local", *scorer.inputs))
    folded = ranged.withColumn("_swept", fold(F.struct(*needed)))
    return folded.select(*ranged.columns, *[f"_swept.{c}" for c in names])


# -- scorers that a user names ------------------------------------------------


def load_scorer(name: str) -> Callable[[pd.DataFrame], object]:
    """The callable that ``module:callable`` names; errors say which part is wrong."""
    module, colon, attribute = name.partition(":")
    if not (module and colon and attribute):
        raise ValueError(f"a scorer is named as module:callable, not {name!r}")
    found = getattr(importlib.import_module(module), attribute, None)
    if found is None:
        raise AttributeError(f"module {module!r} has no {attribute!r}")
    if not callable(found):
        raise TypeError(f"{attribute!r} of module {module!r} is not callable")
    return found


@lru_cache(maxsize=4)
def _external(name: str, inputs: tuple[str, ...]) -> GridFunction:
    call = load_scorer(name)

    def score(orders: pd.DataFrame, prices: np.ndarray) -> np.ndarray:
        n, m = prices.shape
        points = pd.DataFrame({c: orders[c].array.repeat(m) for c in inputs}, copy=False)
        points["price"] = prices.ravel()
        return np.asarray(call(points), dtype=np.float64).reshape(n, m)

    return score


def score_external(name: str) -> GridScorer:
    """A scorer of the user's own: ``name`` is ``module:callable``, on the Python path of all workers.

    The callable gets a pandas frame with a row for each candidate price (the request's fields, the
    looked-up history columns, ``reference_price`` and ``price``) and returns their probabilities of
    acceptance in the same order. The name is checked here, before any job starts; each worker then
    loads the module once.
    """
    load_scorer(name)
    inputs = (*ORDER_FIELDS, *USER.served, *DRIVER.served, "reference_price")
    return GridScorer(inputs, lambda: _external(name, inputs))


def configured_scorer(spark: SparkSession) -> Scorer | GridScorer:
    """The scorer that the session setting ``farelens.scorer`` names; the logistic score without one."""
    name = (spark.conf.get(SCORER_SETTING, None) or "").strip()
    return score_external(name) if name else score_logistic()


def logistic(points: pd.DataFrame) -> np.ndarray:
    """The fixed logistic score as a callable that ``score_external`` can name."""
    hour = pd.to_datetime(points["order_timestamp"], unit="s").dt.hour
    peak = (hour.between(7, 9) | hour.between(17, 20)).to_numpy(np.float64)
    km = points["distance_in_meters"].to_numpy(np.float64) / 1000.0
    rest = 1.2 + peak * 0.15 - km * 0.02 + points["driver_acceptance_rate"].to_numpy(np.float64) * 0.5
    price, reference = (points[c].to_numpy(np.float64) for c in ("price", "reference_price"))
    percent = (price - reference) / reference * 100
    return 1.0 / (1.0 + np.exp(-(rest - percent * 0.02)))
