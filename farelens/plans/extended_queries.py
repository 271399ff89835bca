"""Queries over what the engine adds around a scan, a clean, a join and a stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.operators import bands, cleaning, features, fitted_columns, sketches
from farelens.operators.pricing import with_search_range
from farelens.operators.scoring import score_logistic
from farelens.plans import oracle_views as o
from farelens.plans.bid_queries import ANOMALY_COUNTS_SQL, CLEAN_STRICT_SQL
from farelens.plans.data import KEY, Data
from farelens.plans.registry import query, rounded
from farelens.schema import BID_FIELDS
from farelens.session import scratch_path
from farelens.sources import checked_bids
from farelens.sources import history as history_source
from farelens.sources.bids import bids_of

# -- bad records and file order ----------------------------------------------

_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
_TORN = {2: "short line", 5: "long line", 7: "unreadable value", 11: "unreadable value"}


def _texts(bids: DataFrame) -> DataFrame:
    """Bid fields as the text a CSV file holds."""
    return bids.select(
        *[
            (F.date_format(c, _TIME_FORMAT) if kind == "timestamp" else F.col(c).cast("string")).alias(c)
            for c, kind in BID_FIELDS.items()
        ]
    )


@query(
    "scan_rejects",
    """SELECT reason, field, text, count(*) AS n_rows, CAST(sum(order_id) AS BIGINT) AS ids FROM (
 SELECT order_id, CASE order_id % 19 WHEN 2 THEN 'short line' WHEN 5 THEN 'long line' WHEN 7 THEN 'unreadable value' WHEN 11 THEN 'unreadable value' ELSE 'read' END AS reason,
  CASE order_id % 19 WHEN 7 THEN 'distance_in_meters' WHEN 11 THEN 'tender_timestamp' ELSE '' END AS field,
  CASE order_id % 19 WHEN 7 THEN 'far' WHEN 11 THEN 'soon' ELSE '' END AS text FROM bids
 UNION ALL SELECT order_id, 'read', '', '' FROM bids WHERE order_id % 19 IN (7, 11) ) told GROUP BY reason, field, text""",
)
def _scan_rejects(d: Data) -> DataFrame:
    """Bids from lines of which some are torn, run on, or hold words where numbers belong: read, and not read."""
    kind = F.col("order_id").cast("bigint") % 19
    texts = _texts(d.bids).withColumns(
        {
            "distance_in_meters": F.when(kind == 7, "far").otherwise(F.col("distance_in_meters")),
            "tender_timestamp": F.when(kind == 11, "soon").otherwise(F.col("tender_timestamp")),
        }
    )
    line = F.to_csv(F.struct(*BID_FIELDS))
    torn = F.when(kind == 2, F.regexp_replace(line, ",[^,]*,[^,]*$", "")).when(kind == 5, F.concat(line, F.lit(",more,1")))
    path = scratch_path(d.spark, "lines")
    texts.select(torn.otherwise(line).alias("value")).write.text(path)
    checked = checked_bids.scan_bids_checked(d.spark, path, columns=list(BID_FIELDS))
    read = checked_bids.readable_bids(checked).select(
        "order_id", F.lit("read").alias("reason"), F.lit("").alias("field"), F.lit("").alias("text")
    )
    numbered = checked_bids.with_file_rows(checked)
    place = ["file_path", "file_row"]
    # A line that was read lost single values; its id stands in the row, that of other lines in the text.
    ids = numbered.select(*place, F.coalesce("order_id", F.split_part("unreadable", F.lit(","), F.lit(1)).try_cast("bigint")).alias("order_id"))
    whole = F.col("reason") != "unreadable value"
    refused = checked_bids.bid_rejects(numbered).join(ids, place).select(
        "order_id", "reason", F.coalesce("field", F.lit("")).alias("field"), F.when(whole, "").otherwise(F.col("text")).alias("text")
    )
    told = read.unionByName(refused).groupBy("reason", "field", "text")
    return told.agg(F.count("*").alias("n_rows"), F.sum("order_id").alias("ids"))


# Lines of one file at most, about; each file is put in order by one task.
ROWS_OF_FILE = 500_000


def ordered_bids(d: Data, files: int) -> DataFrame:
    """Bids in as many ranges of orders as there are files; lines are placed while they are narrow."""
    own = [c for c in KEY if c not in BID_FIELDS]
    rows = bids_of(d.lines.repartitionByRange(files, "order_id")).select(*own, *BID_FIELDS)
    return rows.sortWithinPartitions("order_id", *d.row_order)


@query("file_order", f"SELECT {', '.join(KEY)}, is_done FROM marked WHERE NOT exact_duplicate")
def _file_order(d: Data) -> DataFrame:
    """First of each group of copies by the order of lines in files, which are as good as one big file each."""
    path = scratch_path(d.spark, "ordered")
    rows = ordered_bids(d, max(4, d.lines.count() // ROWS_OF_FILE))
    rows.write.option("header", True).option("timestampFormat", _TIME_FORMAT).csv(path)
    checked = checked_bids.readable_bids(checked_bids.scan_bids_checked(d.spark, path))
    types = dict(d.kept_bids.select(*KEY).dtypes)
    typed = checked.withColumns({c: F.col(c).cast(types[c]) for c in KEY})
    return cleaning.dedupe_first(typed, checked_bids.FILE_ORDER).select(*KEY, "is_done")


# -- cleaning with its report ------------------------------------------------


@query("clean_report", ANOMALY_COUNTS_SQL)
def _clean_report(d: Data) -> DataFrame:
    """Problems as counted while the cleaned bids were written."""
    path = scratch_path(d.spark, "cleaned")
    counts, _ = cleaning.clean_and_report(d.bids, d.row_order, path, only_accepted=True)
    return counts


@query("clean_written", CLEAN_STRICT_SQL)
def _clean_written(d: Data) -> DataFrame:
    """The bids that the same pass wrote, in strict mode."""
    path = scratch_path(d.spark, "cleaned")
    cleaning.clean_and_report(d.bids, d.row_order, path, soft=False)
    return rounded(d.spark.read.parquet(path).select(*KEY, "pickup_ratio"))


# -- bands that users supply ---------------------------------------------------

_BANDS = """SELECT s_suppkey AS band, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST((s_suppkey * 37) % 700 AS DOUBLE) END AS band_low,
 CASE WHEN s_suppkey % 10 = 1 THEN NULL ELSE CAST((s_suppkey * 37) % 700 + 20 + (s_suppkey % 7) * 60 AS DOUBLE) END AS band_high FROM {supplier}"""


@query(
    "band_join",
    f"""SELECT band, count(*) AS n_bids, money(sum(price_bid_local)) AS total FROM bids JOIN ({_BANDS.format(supplier='supplier')}) held
 ON price_bid_local >= coalesce(band_low, -1e308) AND price_bid_local < coalesce(band_high, 1e308) GROUP BY band""",
)
def _band_join(d: Data) -> DataFrame:
    """Bids per price band, the bands overlapping and some without an end."""
    supplier = d.spark.read.parquet(f"{d.folder}/supplier.parquet")
    held = d.spark.sql(_BANDS.format(supplier="{supplier}"), supplier=supplier)
    joined = bands.join_bands(d.bids.select("price_bid_local"), held, price="price_bid_local", sums=("price_bid_local",))
    return joined.groupBy("band").agg(F.sum("n_points").alias("n_bids"), F.round(F.sum("sum_price_bid_local"), 2).alias("total"))


# -- history published as one -------------------------------------------------

_HISTORY = ("driver_avg_bid", "driver_is_active")


@query("publish_history", f"SELECT driver_id, driver_bid_count, {o.r(*_HISTORY)}, 2 AS version, (SELECT count(*) FROM uh ) AS n_users FROM dh")
def _publish_history(d: Data) -> DataFrame:
    """Both tables of the second of two versions."""
    folder = scratch_path(d.spark, "published")
    history_source.publish_history(d.bids.filter("order_id % 2 = 0"), folder)
    version = history_source.publish_history(d.bids, folder)
    users, drivers = history_source.source_history(d.spark, folder)
    n_users = users.agg(F.count("*")).scalar()
    out = drivers.select("driver_id", "driver_bid_count", *_HISTORY)
    return rounded(out.withColumns({"version": F.lit(version).cast("int"), "n_users": n_users}))


# -- sketches -------------------------------------------------------------------

_SKETCH_PARTS = "platform, CAST(month(order_timestamp) AS INT) AS part_month"


@query(
    "prob_sketch",
    f"""SELECT platform, count(probability) AS n, {o.exact('min(probability)', 6)} AS min, {o.exact('max(probability)', 6)} AS max,
 {o.exact('avg(probability)', 6)} AS mean, true AS q1_close, true AS median_close, true AS q3_close FROM score_rows GROUP BY platform""",
)
def _prob_sketch(d: Data) -> DataFrame:
    """Quartiles of scores out of monthly sketches, each checked against the ranks of all scores."""
    scored = d.scored_bids.select("platform", F.month("order_timestamp").alias("part_month"), "probability")
    parts = sketches.sketch_parts(scored, ["platform", "part_month"], "probability")
    merged = sketches.merge_parts(parts, ["platform"])
    report = sketches.sketch_report(merged, ["platform"]).join(merged.select("platform", "n"), "platform")
    ranks = scored.join(F.broadcast(report.select("platform", *sketches.QUARTILES)), "platform").groupBy("platform").agg(
        *[
            F.struct(
                F.avg(F.when(F.col("probability") < F.col(q), 1.0).otherwise(0.0)).alias("below"),
                F.avg(F.when(F.col("probability") <= F.col(q), 1.0).otherwise(0.0)).alias("upto"),
            ).alias(f"{q}_rank")
            for q in sketches.QUARTILES
        ]
    )
    close = [
        ((F.col(f"{q}_rank.below") <= p + 2 * sketches.RANK_ERROR) & (F.col(f"{q}_rank.upto") >= p - 2 * sketches.RANK_ERROR)).alias(f"{q}_close")
        for q, p in sketches.QUARTILES.items()
    ]
    return rounded(report.join(ranks, "platform").select("platform", "n", "min", "max", "mean", *close))


# -- statistics that a stored pipeline carries -----------------------------------

_FITTED = ("driver_rating", "price_increase_pct", "rating_x_price_inc", "price_per_km", "distance_km")
_WIDTH = 0.5


def _stored_sql() -> str:
    middles = ", ".join(f"median({c}) AS med_{c}" for c in _FITTED)
    filled = ", ".join(f"coalesce({c}, med_{c}, 0e0) AS {c}, med_{c}" for c in _FITTED)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, any_value(med_{c}) AS med_{c}" for c in _FITTED)
    gaps = "CASE WHEN order_id % 7 = 0 THEN NULL ELSE driver_rating END AS driver_rating"
    clamped = ", ".join(
        o.exact(f"least(greatest(coalesce(t.{c}, med_{c}, 0e0), m_{c} - {_WIDTH} * s_{c}), m_{c} + {_WIDTH} * s_{c})", 4) + f" AS {c}"
        for c in _FITTED
    )
    return f"""SELECT order_id, {clamped} FROM (SELECT * REPLACE ({gaps}) FROM serve ) t, (SELECT {stats} FROM
 (SELECT {filled} FROM feat , (SELECT {middles} FROM feat ) middle) known) fitted"""


@query("stored_statistics", _stored_sql())
def _stored_statistics(d: Data) -> DataFrame:
    """Medians and bounds of the bids' features, stored, read again and applied to requests with gaps."""
    raw = features.as_features(features.row_features(d.kept_bids), _FITTED)
    bounds = fitted_columns.ColumnBounds(inputCols=list(_FITTED), width=_WIDTH).fit(raw)
    path = scratch_path(d.spark, "bounds")
    bounds.write().overwrite().save(path)
    again = fitted_columns.ColumnBoundsModel.load(path)
    ranged = with_search_range(score_logistic().prepare(d.prepared))
    served = features.serving_features(ranged.withColumn("price", F.col("price_start_local") * 1.2), keep=("order_id",))
    gaps = F.when(F.col("order_id") % 7 != 0, F.col("driver_rating"))
    return rounded(again.transform(served.withColumn("driver_rating", gaps)).select("order_id", *_FITTED), 4)
