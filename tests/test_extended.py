"""Torn records, file order, one-pass cleaning, supplied bands, published history, sketches, stored statistics."""

import json
import random
from types import SimpleNamespace

import pytest
from conftest import FOLDER
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from farelens.operators import bands, cleaning, fitted_columns, modelling, sketches, statistics
from farelens.operators.features import BASE_FEATURES, serving_features
from farelens.operators.pricing import with_search_range
from farelens.operators.scoring import score_logistic
from farelens.plans import extended_queries
from farelens.plans.data import Data
from farelens.schema import BID_FIELDS
from farelens.session import cut_lineage, scratch_path, scratch_root
from farelens.sources import checked_bids, predictions
from farelens.sources import history as history_source
from farelens.streaming.recommend import rejected_requests, stream_orders, stream_recommend

HEADER = ",".join(BID_FIELDS)


def line(**changes):
    values = {
        "order_id": 1, "user_id": 2, "driver_id": 3, "order_timestamp": "2024-05-01 10:00:00",
        "tender_timestamp": "2024-05-01 10:00:09", "driver_reg_date": "2020-01-01 00:00:00", "distance_in_meters": 900,
        "duration_in_seconds": 300, "pickup_in_meters": 100, "pickup_in_seconds": 60, "driver_rating": 4.5,
        "carname": "Lada", "carmodel": "Vesta", "platform": "ios", "price_start_local": 100, "price_bid_local": 120, "is_done": "done",
    }
    return ",".join(str(v) for v in (values | changes).values())


def write(path, *lines):
    path.mkdir(exist_ok=True)
    for i, part in enumerate(lines):
        (path / f"part-{i}.csv").write_text("\n".join(part) + "\n")
    return str(path)


# -- bad records -----------------------------------------------------------------


def test_every_line_is_found_again(spark, tmp_path):
    lines = [
        line(order_id=0), line(order_id=1).rsplit(",", 2)[0], line(order_id=2) + ",more", "", '"torn',
        line(order_id=3, distance_in_meters="far", driver_rating="good"), line(order_id=4, tender_timestamp="soon"),
        line(order_id="five"), line(order_id=6, carname='"Lada, new"', driver_rating=""), line(order_id="7.0", driver_rating="NaN"),
        line(order_id=8, carname='"a ""b"", c"') + ',"x,y"',
    ]
    checked = checked_bids.with_file_rows(checked_bids.scan_bids_checked(spark, write(tmp_path / "csv", [HEADER, *lines])))
    read = checked_bids.readable_bids(checked)
    assert sorted(map(str, [r.order_id for r in read.collect()])) == ["0", "3", "4", "6", "7", "None"]
    assert read.filter("order_id = 6").first().carname == "Lada, new"
    assert read.filter("order_id = 7").first().driver_rating is None
    refused = checked_bids.bid_rejects(checked).orderBy("file_row", "field").collect()
    found = [(r.file_row, r.reason, r.field, r.text) for r in refused]
    # Blank lines are no rows.
    assert found == [
        (1, "short line", None, lines[1]), (2, "long line", None, lines[2]), (3, "short line", None, '"torn'),
        (4, "unreadable value", "distance_in_meters", "far"), (4, "unreadable value", "driver_rating", "good"),
        (5, "unreadable value", "tender_timestamp", "soon"), (6, "unreadable value", "order_id", "five"),
        (9, "long line", None, lines[10]),
    ]


def test_files_without_header(spark, tmp_path):
    path = write(tmp_path / "csv", [line(order_id=1), line(order_id=2) + ","])
    checked = checked_bids.scan_bids_checked(spark, path, columns=list(BID_FIELDS))
    assert [r.order_id for r in checked_bids.readable_bids(checked).collect()] == [1]
    assert [r.reason for r in checked_bids.bid_rejects(checked).collect()] == ["long line"]


@pytest.fixture
def split_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        for k in keys:
            spark.conf.set(k, size)

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def test_file_order_does_not_depend_on_splits(spark, tmp_path, split_size):
    rng = random.Random(1)
    files = [[HEADER, *[line(order_id=rng.randrange(40), carname=f"car{f}_{i}") for i in range(n)]] for f, n in enumerate((500, 30, 900, 1))]
    path = write(tmp_path / "csv", *files)
    firsts, places = [], []
    for size in ("128m", "7k", "1k"):
        split_size(size)
        checked = checked_bids.with_file_rows(checked_bids.scan_bids_checked(spark, path))
        assert size == "128m" or checked.select("file_block").distinct().count() > 4
        rows = checked_bids.readable_bids(checked)
        places.append(sorted((r.file_path, r.file_row, r.carname) for r in rows.collect()))
        firsts.append(sorted((r.order_id, r.carname) for r in cleaning.dedupe_first(rows, checked_bids.FILE_ORDER).collect()))
    assert places[0] == places[1] == places[2] and firsts[0] == firsts[1] == firsts[2]
    assert [name for _, _, name in places[0]] == [f"car{f}_{i}" for f, n in enumerate((500, 30, 900, 1)) for i in range(n)]
    seen = {}
    for f, lines in enumerate(files):
        for text in lines[1:]:
            seen.setdefault(int(text.split(",")[0]), text.split(",")[11])
    assert firsts[0] == sorted(seen.items())


def test_rows_are_numbered_alike_where_blocks_are_joined(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "csv", [HEADER, *[line(order_id=i) for i in range(50)]])
    monkeypatch.setattr(checked_bids, "BROADCAST_BLOCKS", 0)
    rows = checked_bids.with_file_rows(checked_bids.scan_bids_checked(spark, path)).collect()
    assert all(r.file_row == r.order_id for r in rows)


# -- cleaning with its report ------------------------------------------------------


@pytest.mark.parametrize(("soft", "accepted"), [(True, False), (False, False), (True, True), (False, True)])
def test_one_pass_cleans_and_counts(spark, soft, accepted):
    d = Data(spark, FOLDER)
    path = scratch_path(spark, "cleaned")
    counts, summary = cleaning.clean_and_report(d.bids, d.row_order, path, soft, accepted)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, cleaning.anomaly_counts(d.bids, d.row_order, accepted).collect()))
    (found,), (expected,) = summary.collect(), cleaning.clean_summary(d.bids, d.row_order, soft, accepted).collect()
    assert tuple(found) == pytest.approx(tuple(expected))
    written, kept = spark.read.parquet(path), cleaning.clean(d.bids, d.row_order, soft, accepted)
    assert written.columns == kept.columns
    assert written.exceptAll(kept).count() == kept.exceptAll(written).count() == 0


def test_cleaning_reads_the_bids_once(spark, tmp_path):
    d = Data(spark, FOLDER)
    path = scratch_path(spark, "bids")
    d.bids.write.parquet(path)
    groups, _ = cleaning.cleaned_groups(spark.read.parquet(path), d.row_order)
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1


def test_empty_bids_are_cleaned(spark):
    d = Data(spark, FOLDER)
    counts, summary = cleaning.clean_and_report(d.bids.limit(0), d.row_order, scratch_path(spark, "cleaned"))
    assert counts.count() == 0 and summary.first()["initial"] == summary.first()["kept"] == 0


# -- bands ----------------------------------------------------------------------------


def brute_bands(prices, held):
    low, high = float("-inf"), float("inf")
    return sorted(
        (p, b) for p in prices if p is not None and p == p for b, lo, hi in held
        if (low if lo is None else lo) <= p < (high if hi is None else hi)
    )


@pytest.mark.parametrize(("bins", "broadcast_rows"), [(1024, 200_000), (8, 200_000), (8, 0), (2, 0)])
def test_supplied_bands(spark, bins, broadcast_rows):
    rng = random.Random(bins)
    prices = [rng.choice((float(rng.randrange(100)), rng.uniform(-20, 120))) for _ in range(400)] + [None, float("nan"), 1e300, -1e300, 50.0]
    held = [(0, None, None), (1, None, 10.0), (2, 90.0, None), (3, 50.0, 50.0), (4, 60.0, 40.0)]
    held += [(5 + i, lo, lo + rng.choice((0.5, 5.0, 60.0))) for i, lo in enumerate(float(rng.randrange(100)) for _ in range(60))]
    points = spark.createDataFrame([(p,) for p in prices], "price double")
    table = spark.createDataFrame(held, "band int, band_low double, band_high double")
    joined = bands.join_bands(points, table, bins=bins, broadcast_rows=broadcast_rows)
    assert joined.columns == ["price", "band", "band_low", "band_high"]
    assert sorted((r.price, r.band) for r in joined.collect()) == brute_bands(prices, held)


def test_no_bands_and_no_edges(spark):
    points = spark.createDataFrame([(1.0,)], "price double")
    schema = "band int, band_low double, band_high double"
    assert bands.join_bands(points, spark.createDataFrame([], schema)).count() == 0
    assert bands.join_bands(points, spark.createDataFrame([(1, None, None)], schema)).count() == 1


@pytest.mark.parametrize("cells", [65_536, 9, 2])
def test_sums_of_supplied_bands(spark, cells):
    rng = random.Random(cells)
    prices = [rng.choice((float(rng.randrange(100)), rng.uniform(-20, 120))) for _ in range(400)]
    prices += [None, float("nan"), float("inf"), float("-inf"), 1e300, -1e300, 50.0]
    held = [(0, None, None), (1, None, 10.0), (2, 90.0, None), (3, 50.0, 50.0), (4, 60.0, 40.0), (5, float("nan"), 10.0), (1, 20.0, 30.0)]
    held += [(6 + i, lo, lo + rng.choice((0.5, 5.0, 60.0))) for i, lo in enumerate(float(rng.randrange(100)) for _ in range(60))]
    points = spark.createDataFrame([(p, i % 7) for i, p in enumerate(prices)], "price double, amount int")
    table = spark.createDataFrame(held, "band int, band_low double, band_high double")
    runs = bands.join_bands(points, table, sums=("amount",), cells=cells)
    assert runs.columns == ["band", "band_low", "band_high", "n_points", "sum_amount"]
    found = {r[0]: tuple(r)[1:] for r in runs.groupBy("band").agg(F.sum("n_points"), F.sum("sum_amount")).collect()}
    amounts = dict(enumerate(i % 7 for i in range(len(prices))))
    expected = {}
    for b, lo, hi in held:
        lo, hi = float("-inf") if lo is None or lo != lo else lo, float("inf") if hi is None else hi
        for i, p in enumerate(prices):
            if p is not None and lo <= p < hi:
                n, total = expected.get(b, (0, 0))
                expected[b] = n + 1, total + amounts[i]
    assert found == expected


def test_summed_bands_do_not_pair_prices_with_bands(spark):
    points = spark.range(20_000).select((F.col("id") % 1000).cast("double").alias("price"))
    table = spark.range(200).select(F.col("id").alias("band"), F.lit(0.0).alias("band_low"), (F.col("id") * 5.0).alias("band_high"))
    assert bands.join_bands(points, table).count() == sum(20 * 5 * i for i in range(200))
    assert bands.join_bands(points, table, sums=("price",)).count() <= 200 * 2 * 8


def test_no_bands_to_sum(spark):
    points = spark.createDataFrame([(1.0,)], "price double")
    schema = "band int, band_low double, band_high double"
    assert bands.join_bands(points, spark.createDataFrame([], schema), sums=("price",)).count() == 0
    (row,) = bands.join_bands(points, spark.createDataFrame([(1, None, None)], schema), sums=("price",)).collect()
    assert tuple(row) == (1, None, None, 1, 1.0)


def test_ordered_files_are_as_many_as_the_lines_ask_for(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(extended_queries, "ROWS_OF_FILE", 500)
    monkeypatch.setattr(extended_queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    data = Data(spark, FOLDER)
    assert extended_queries._file_order(data).count() == cleaning.dedupe_first(data.bids, data.row_order).count()
    assert len(list(tmp_path.glob("ordered/*.csv"))) > 8


def test_lines_are_placed_in_files_while_narrow(spark):
    """The exchange carries no column that bids only get from their lines; the order in files is that of all bids."""
    data = Data(spark, FOLDER)
    rows = extended_queries.ordered_bids(data, 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange rangepartitioning") :]
    assert "disc" in below and not any(c in below for c in ("carname", "tender_timestamp", "distance_in_meters"))
    keys = ["order_id", *data.row_order]
    placed = [tuple(r) for r in rows.select(*keys).collect()]
    assert placed == [tuple(r) for r in data.bids.select(*keys).orderBy(*keys).collect()]


# -- history ------------------------------------------------------------------------


def totals(tables):
    users, drivers = tables
    return users.agg(F.sum("user_order_count")).first()[0], drivers.agg(F.sum("driver_bid_count")).first()[0]


def test_a_failed_writer_publishes_nothing(spark, monkeypatch):
    bids, folder = Data(spark, FOLDER).bids, scratch_path(spark, "published")
    assert history_source.published_history(spark, folder)["version"] == 0
    assert history_source.publish_history(bids.filter("order_id % 2 = 0"), folder) == 1
    before = totals(history_source.source_history(spark, folder))
    build = history_source.build_history

    def fails(bids, side):
        if side is history_source.DRIVER:
            raise RuntimeError("lost")
        return build(bids, side)

    monkeypatch.setattr(history_source, "build_history", fails)
    with pytest.raises(RuntimeError):
        history_source.publish_history(bids, folder)
    assert history_source.published_history(spark, folder)["version"] == 1
    assert totals(history_source.source_history(spark, folder)) == before
    monkeypatch.undo()
    readers = history_source.source_history(spark, folder)
    assert history_source.publish_history(bids, folder) == 2
    after = totals(history_source.source_history(spark, folder))
    assert after[0] > before[0] and after[1] > before[1]
    assert totals(readers) == before  # files of an earlier version stay


def test_refresh_publishes(spark, tmp_path):
    folder = scratch_path(spark, "refreshed")
    path = write(tmp_path / "csv", [HEADER, line(order_id=1), line(order_id=2, is_done="cancel")])
    assert not history_source.refresh_history(spark, folder, [str(tmp_path / "absent")])
    assert history_source.refresh_history(spark, folder, [path])
    assert history_source.refresh_history(spark, folder, [path]) and history_source.published_history(spark, folder)["version"] == 1
    assert history_source.refresh_history(spark, folder, [path], force=True)
    assert history_source.published_history(spark, folder)["version"] == 2
    assert totals(history_source.source_history(spark, folder)) == (2, 2)


# -- sketches -----------------------------------------------------------------------


def test_merged_sketches_keep_their_error(spark):
    rng = random.Random(9)
    values = [(i % 13, rng.lognormvariate(0, 2) if i % 3 else 1.0) for i in range(30_000)] + [(99, None), (98, float("nan"))]
    df = spark.createDataFrame(values, "part int, v double").repartition(8)
    parts = sketches.sketch_parts(df, ["part"], "v")
    assert {r.part for r in parts.select("part").collect()} == set(range(13))
    path = scratch_path(spark, "sketches")
    parts.filter("part < 12").write.parquet(path)
    parts.filter("part = 12").write.mode("append").parquet(path)  # a part that came later, read alone
    for by_halves in (False, True):
        stored = spark.read.parquet(path)
        merged = sketches.merge_parts(stored.withColumn("half", F.col("part") % 2), ["half"]) if by_halves else stored
        (row,) = sketches.sketch_report(sketches.merge_parts(merged)).collect()
        known = sorted(v for _, v in values if v is not None and v == v)
        exact = statistics.prob_quantiles(df.filter("v IS NOT NULL AND NOT isnan(v)"), "v").first()
        assert (row["min"], row["max"]) == (exact["min"], exact["max"]) and row["mean"] == pytest.approx(exact["mean"])
        for name, p in sketches.QUARTILES.items():
            below = sum(v < row[name] for v in known) / len(known)
            upto = sum(v <= row[name] for v in known) / len(known)
            assert below - sketches.RANK_ERROR <= p <= upto + sketches.RANK_ERROR


# -- stored statistics -----------------------------------------------------------------


def test_bounds_are_those_of_the_feature_table(spark):
    d = Data(spark, FOLDER)
    columns = ("driver_rating", "price_increase_pct", "price_to_fuel_ratio", "price_per_km")
    raw = d.features.select("k_order_id", *columns)
    fitted = fitted_columns.ColumnBounds(inputCols=list(columns), width=2.0).fit(raw)
    stats = statistics.fit_statistics(raw, list(columns), 2.0)
    expected = statistics.clip_sigma(statistics.impute(raw, stats), stats)
    found = fitted.transform(raw)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    # A column that was complete fills the gaps of other tables near its median.
    middle = raw.agg(F.median("price_per_km")).first()[0]
    assert fitted.statistics()["price_per_km"].fill == pytest.approx(middle, rel=0.01)
    gap = spark.createDataFrame([(None, float("inf"), -1e9, 1e9)], ", ".join(f"{c} double" for c in columns))
    (row,) = fitted.transform(gap).collect()
    kept = fitted.statistics()
    assert tuple(row) == (
        kept["driver_rating"].fill, kept["price_increase_pct"].fill, kept["price_to_fuel_ratio"].low, kept["price_per_km"].high,
    )


def test_a_stored_pipeline_scores_raw_features_of_another_table(spark):
    d = Data(spark, FOLDER)
    raw = cut_lineage(d.features.select("label", *BASE_FEATURES))
    bounds = fitted_columns.ColumnBounds(inputCols=list(BASE_FEATURES)).fit(raw)
    train = cut_lineage(bounds.transform(raw))
    trees = modelling.train_classifier(train, settings=modelling.TreeSettings(iterations=3, depth=3))
    model = fitted_columns.with_statistics(bounds, modelling.calibrate_sigmoid(trees, train))
    path = scratch_path(spark, "pipeline")
    predictions.sink_model(model, path)
    again = predictions.source_model(path, BASE_FEATURES)
    assert isinstance(again, PipelineModel) and isinstance(again.stages[0], fitted_columns.ColumnBoundsModel)
    ranged = with_search_range(score_logistic().prepare(d.prepared))
    other = serving_features(ranged.withColumn("price", F.col("price_start_local") * 1.2), keep=("order_id",))
    holes = other.withColumns({c: F.when(F.col("order_id") % 5 != i, F.col(c)) for i, c in enumerate(BASE_FEATURES[:5])})
    own = sorted(map(tuple, modelling.predict_proba(model, holes).select("order_id", "probability").collect()))
    assert own == sorted(map(tuple, modelling.predict_proba(again, holes).select("order_id", "probability").collect()))
    assert len(own) == other.count() and len({p for _, p in own}) > 10


# -- dead letters ----------------------------------------------------------------------


def test_each_request_is_priced_or_refused_once(spark, tmp_path):
    d = Data(spark, FOLDER)
    incoming, out = tmp_path / "incoming", str(tmp_path / "out")
    incoming.mkdir()
    good = [json.loads(r) for r in d.orders.withColumn("driver_rating", F.lit(4.0)).limit(12).toJSON().collect()]
    bad = [{**good[0], "order_id": -1, "platform": "desktop"}, {**good[1], "order_id": -2, "driver_rating": 7.0, "pickup_in_meters": -3}]
    texts = [json.dumps(r) for r in good + bad] + ['{"order_id": 5, "plat', "no request", json.dumps({**good[2], "order_id": -3, "distance_in_meters": "far"})]

    def run():
        stream = stream_recommend(stream_orders(spark, str(incoming), 1), d.users, d.drivers, d.scorer, out, str(tmp_path / "progress"), 10, 20)
        stream.awaitTermination()
        priced = [r.order_id for r in spark.read.parquet(f"{out}/batch=*").collect()]
        refused = rejected_requests(spark, f"{out}_rejected").collect()
        return sorted(priced), refused

    (incoming / "a.json").write_text("\n".join(texts[:9]))
    run()
    (incoming / "b.json").write_text("\n".join(texts[9:]))
    priced, refused = run()
    assert priced == sorted(r["order_id"] for r in good) and len(priced) + len(refused) == len(texts)
    reasons = {r.order_id: r.errors for r in refused if r.order_id is not None and r.order_id < 0}
    assert reasons[-1] == ["platform"] and reasons[-2] == ["pickup_in_meters", "driver_rating"]
    assert reasons[-3] == ["unreadable", "distance_in_meters"]
    assert {r.unreadable for r in refused if r.unreadable} >= set(texts[-3:-1])
    assert run()[0] == priced  # nothing comes twice


# -- the shared folder -------------------------------------------------------------------


@pytest.mark.parametrize(("master", "folder", "expected"), [
    ("spark://host:7077", "hdfs://name/scratch/", "hdfs://name/scratch"), ("spark://host:7077", None, None), ("yarn", "", None),
])
def test_a_cluster_needs_a_shared_folder(master, folder, expected):
    context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: {"spark.checkpoint.dir": folder})
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    if expected is None:
        with pytest.raises(ValueError):
            scratch_root(session)
    else:
        assert scratch_root(session) == expected
