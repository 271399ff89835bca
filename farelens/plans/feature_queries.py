"""Queries over the feature table: groups, statistics and the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.operators import features, statistics
from farelens.operators.modelling import feature_table
from farelens.operators.scoring import score_logistic
from farelens.plans import oracle_views as o
from farelens.plans.data import Data
from farelens.plans.registry import query, quick_round, rounded

K = o.KEY
_KK = ("k_order_id", "k_copy_no", "k_line_no", "k_driver_id", "k_part_id", "k_ext")
_KEY_AS_K = ", ".join(f"{k.removeprefix('k_')} AS {k}" for k in _KK)


def _keyed(bids: DataFrame) -> DataFrame:
    """Bids whose key columns survive next to equally named features."""
    return bids.withColumns({k: F.col(k.removeprefix("k_")) for k in _KK})


def _group(name: str, columns: tuple[str, ...]) -> None:
    @query(f"features_{name}", f"SELECT {_KEY_AS_K}, {o.r(*columns)} FROM feat")
    def _run(d: Data) -> DataFrame:
        if name in ("user", "driver_hist", "match"):
            wide = features.with_match(_keyed(d.joined))
        else:
            wide = features.row_features(_keyed(d.bids))
        return rounded(features.as_features(wide, columns, keep=_KK))


for _name, _columns in features.GROUPS.items():
    _group(_name, _columns)


@query("features_serving", f"SELECT order_id, {o.r(*features.BASE_FEATURES)} FROM serve")
def _features_serving(d: Data) -> DataFrame:
    """Serving features at 1.2 times the start price."""
    from farelens.operators.pricing import with_search_range

    ranged = with_search_range(score_logistic().prepare(d.prepared))
    priced = ranged.withColumn("price", F.col("price_start_local") * 1.2)
    return rounded(features.serving_features(priced, keep=("order_id",)))


# The columns of the bid view that can be missing.
_LACKING = (
    "driver_rating", "rating_deviation", "net_profit_x_rating", "rating_x_price_inc",
    "price_increase_pct", "price_inc_x_distance", "price_inc_x_night", "price_inc_x_peak",
    "price_inc_x_weekend", "experience_x_price_inc",
)


@query(
    "impute_median",
    f"SELECT {_KEY_AS_K}, "
    + ", ".join(f"round(coalesce({c}, med_{c}, 0e0), 6) + 0e0 AS {c}" for c in _LACKING)
    + f" FROM feat , (SELECT {', '.join(f'median({c}) AS med_{c}' for c in _LACKING)} FROM feat ) middles",
)
def _impute_median(d: Data) -> DataFrame:
    wide = features.as_features(features.row_features(_keyed(d.kept_bids)), _LACKING, keep=_KK)
    stats = statistics.fit_statistics(wide, list(_LACKING), impute_only=True)
    return rounded(statistics.impute(wide, stats))


# Columns whose extremes the clip reaches, and one without missing values.
_CLIPPED = ("price_above_min_profitable_pct", "price_to_fuel_ratio", "price_inc_x_distance", "price_per_km")


def _clipped(source: str, columns: tuple[str, ...]) -> str:
    """Clamp of each column of ``source`` to its own mean and ten deviations."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in columns)
    clamped = ", ".join(
        o.exact(
            f"CASE WHEN s_{c} > 0 THEN least(greatest({c}, m_{c} - 10 * s_{c}), m_{c} + 10 * s_{c}) ELSE {c} END",
            4,
        )
        + f" AS {c}"
        for c in columns
    )
    keys = ", ".join(_KK)
    return f"SELECT {keys}, {clamped} FROM {source} , (SELECT {stats} FROM {source} ) fitted"


def _imputed(columns: tuple[str, ...]) -> str:
    lacking = [c for c in columns if c in _LACKING]
    medians = ", ".join(f"median({c}) AS med_{c}" for c in lacking) or "1 AS none"
    picked = ", ".join(f"coalesce({c}, med_{c}, 0e0) AS {c}" if c in lacking else c for c in columns)
    return f"SELECT {_KEY_AS_K}, {picked} FROM feat , (SELECT {medians} FROM feat ) middles"


def _table_sql(columns: tuple[str, ...]) -> str:
    from farelens.plans.oracle_views import VIEWS

    name = f"imputed_{len(columns)}"
    VIEWS.setdefault(name, _imputed(columns))
    return _clipped(name, columns)


# Only what these columns are made of; all 130 go through ``feature_table``.
_CLIP_INPUTS = f"""SELECT {_KEY_AS_K}, price_bid_local * 1e0 / (distance_in_meters / 1000e0 + 0.1e0) AS price_per_km,
 price_bid_local / (cost + 0.1e0) AS price_to_fuel_ratio, (price_bid_local - cost * 1.3e0) / (cost * 1.3e0 + 0.1e0) * 100 AS price_above_min_profitable_pct,
 CASE WHEN price_start_local <> 0 THEN (price_bid_local - price_start_local) / price_start_local * 100 * (distance_in_meters / 1000e0) END AS price_inc_x_distance
FROM (SELECT *, distance_in_meters / 1000e0 * 9e0 / 100e0 * 55e0 AS cost FROM bids ) costed"""
_CLIP_FILLED = f"""SELECT * REPLACE (coalesce(price_inc_x_distance, med, 0e0) AS price_inc_x_distance)
FROM clip_inputs , (SELECT median(price_inc_x_distance) AS med FROM clip_inputs ) middle"""


def _clip_sql() -> str:
    from farelens.plans.oracle_views import VIEWS

    VIEWS.setdefault("clip_inputs", _CLIP_INPUTS)
    VIEWS.setdefault("clip_filled", _CLIP_FILLED)
    return _clipped("clip_filled", _CLIPPED)


@query("clip_sigma", _clip_sql())
def _clip_sigma(d: Data) -> DataFrame:
    wide = features.as_features(features.row_features(_keyed(d.kept_bids)), _CLIPPED, keep=_KK)
    return rounded(feature_table(wide, _CLIPPED).select(*_KK, *_CLIPPED), 4)


@query("feature_table", _table_sql(features.ALL_FEATURES))
def _feature_table(d: Data) -> DataFrame:
    """All 130 columns, imputed and clipped."""
    table = feature_table(d.features, features.ALL_FEATURES)
    doubles = {f.name for f in table.schema.fields if f.dataType.typeName() == "double"}
    columns = [quick_round(F.col(c), 4).alias(c) if c in doubles else c for c in (*_KK, *features.ALL_FEATURES)]
    return table.select(*columns)
