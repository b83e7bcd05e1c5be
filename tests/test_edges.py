"""Small grids with results worked out by hand."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from graticule import GridSpec, MissingRole
from graticule.functions import calendar, classify, wind
from graticule.functions.missing import clean
from graticule.operators import axis, boundary, catalog, cube, indices, series as ser, stats, story
from graticule.operators import wind as winds
from graticule.plans import views
from graticule.sources import tables

NAN, INF = float("nan"), float("inf")


def one(df):
    (row,) = df.collect()
    return row


def test_nan_never_passes_a_threshold(spark):
    raw = spark.createDataFrame([(NAN,), (21.0,)], "value double")
    cells = clean(raw)
    assert cells.where("value > 20").count() == 1
    assert one(stats.value_stats(cells))["n"] == 1


def test_year_without_values(series):
    ts = series(("2001-01-01", NAN), ("2001-01-02", NAN), ("2002-01-01", 1.0))
    assert [(r.year, r.total) for r in ser.annual_total(ts).collect()] == [(2001, 0.0), (2002, 1.0)]
    assert [(r.year, r["mean"]) for r in ser.annual_mean_by_period(ts).collect()] == [(2002, 1.0)]


def test_month_without_values_stays(series):
    ts = series(("2001-01-01", NAN), ("2001-03-02", 4.0), ("2002-03-02", 6.0))
    assert [tuple(r) for r in ser.monthly_cycle(ts).collect()] == [(1, None, "Jan"), (3, 5.0, "Mar")]
    assert [tuple(r) for r in ser.monthly_total(ts).collect()] == [(1, 0.0), (3, 10.0)]


def test_unknown_time_leaves_calendar_groups(series):
    ts = series((None, 7.0), ("2001-01-01", 1.0))
    assert [(r.year, r.total) for r in ser.annual_total(ts).collect()] == [(2001, 1.0)]


def test_periods(spark):
    years = spark.createDataFrame([(2010,), (2011,), (2040,), (2041,)], "year int")
    found = [r[0] for r in years.select(calendar.period(F.col("year"))).collect()]
    assert found == ["Baseline", "Current", "Current", "Future"]


def test_extremes_take_the_first_among_equals(series):
    ts = series(("2001-01-01", 1.0), ("2001-01-02", 35.0), ("2001-01-03", 35.0), ("2001-01-04", 1.0), ("2001-01-05", NAN))
    row = one(indices.extremes(ts))
    assert (row.hottest, row.hottest_date, row.coldest, row.coldest_date) == (35.0, date(2001, 1, 2), 1.0, date(2001, 1, 1))
    assert (row.hot_days, row.tropical_nights) == (2, 2)
    grouped = one(indices.extremes(ts.withColumn("g", F.lit(1)), by=["g"]).drop("g"))
    assert grouped == row


def test_extremes_of_nothing(series):
    row = one(indices.extremes(series(("2001-01-01", NAN))))
    assert (row.hottest, row.hottest_date, row.hot_days) == (None, None, 0)


def test_thresholds_are_strict(series):
    ts = series(("2001-01-01", 20.0), ("2001-01-02", 20.5), ("2001-01-03", 30.0), ("2001-01-04", 0.0))
    assert one(indices.heavy_days(ts)).heavy_days == 2
    assert tuple(one(indices.snow_days(ts))) == (3, 70.5)
    assert one(indices.extremes(ts)).hot_days == 0
    with pytest.raises(ValueError):
        indices.heavy_days(ts, threshold=0.5)


@pytest.mark.parametrize("positions", [True, False])
@pytest.mark.parametrize(
    "values, expected",
    [
        ([0, 0, 5, 0, 0, 0, 9], 3),
        ([0, NAN, 0], 2),
        ([5, 5], 0),
        ([NAN], None),
        ([1.0, 0.5], 1),
    ],
)
def test_dry_streak(series, positions, values, expected):
    ts = series(*[(f"2001-01-{i + 1:02d}", float(v)) for i, v in enumerate(values)])
    ts = ts if positions else ts.drop("time_idx")
    assert one(indices.longest_dry_streak(ts)).longest_dry_streak == expected


def test_dry_streak_crosses_months(series):
    days = ["2001-01-30", "2001-01-31", "2001-02-01", "2001-03-01", "2001-03-02"]
    ts = series(*[(d, v) for d, v in zip(days, [9.0, 0.0, 0.0, 0.0, 9.0])]).drop("time_idx")
    assert one(indices.longest_dry_streak(ts)).longest_dry_streak == 3


def test_mean_of_means(grid):
    cells = grid([(0, 0, 0, 1.0), (1, 0, 0, 3.0), (1, 0, 1, 5.0), (1, 1, 0, 7.0)])
    ts = cube.spatial_mean(cells)
    assert one(ser.annual_mean_by_period(ts))["mean"] == 3.0


def test_spatial_mean_keeps_empty_times_and_levels(spark, grid):
    cells = grid([(0, 0, 0, NAN), (1, 0, 0, 2.0), (1, 0, 1, NAN)])
    found = {r.time_idx: r.value for r in cube.spatial_mean(cells).collect()}
    assert found == {0: None, 1: 2.0}
    levels = grid([(0, 0, 0, 1.0)]).withColumn("lev", F.explode(F.array(F.lit(10.0), F.lit(20.0))))
    assert cube.spatial_mean(levels, GridSpec(extra=("lev",))).count() == 2


def test_spatial_mean_without_a_map_is_identity(grid):
    cells = grid([(0, 0, 0, 1.0), (0, 1, 0, 3.0)]).drop("lon", "lon_idx")
    assert cube.spatial_mean(cells) is cells


def test_constant_slice_is_zero_everywhere(grid):
    cells = grid([(0, 0, 0, 2.0), (0, 0, 1, 2.0), (0, 0, 2, NAN)])
    assert {r.normalised for r in cube.normalise(cells).collect()} == {0.0}
    other = grid([(0, 0, 0, 2.0), (0, 0, 1, 4.0), (0, 0, 2, NAN)])
    assert sorted((r.normalised is None, r.normalised or 0) for r in cube.normalise(other).collect()) == [(False, 0.0), (False, 1.0), (True, 0)]


def test_hotspot_tie_takes_the_first_cell(grid):
    cells = grid([(0, 0, 1, 5.0), (0, 0, 0, -5.0), (0, 1, 0, 4.0), (1, 0, 0, NAN)])
    assert tuple(one(cube.hotspot(cells.where("time_idx = 0")))) == (0.0, 0.0, -5.0)
    assert [tuple(r) for r in cube.hotspot(cells, by=["time_idx"]).collect()] == [(0, 0.0, 0.0, -5.0)]
    assert cube.hotspot(cells.where("time_idx = 1")).count() == 0


def test_infinity(spark):
    cells = spark.createDataFrame([(1.0,), (INF,)], "value double")
    assert one(stats.global_stats(cells)).n_points == 1
    assert tuple(one(stats.value_stats(cells)))[:2] == (2, INF)
    assert one(stats.histogram_range(cells)).n_infinite == 1
    assert [r.n for r in stats.histogram(cells).collect()] == [1]


def test_global_stats(spark):
    cells = spark.createDataFrame([(1.0,), (3.0,)], "value double")
    assert tuple(one(stats.global_stats(cells))) == (2, 2.0, 1.0, 3.0, 1.0)
    assert stats.global_stats(cells.where("value > 9")).count() == 0


@pytest.mark.parametrize(
    "values, width, bins",
    [
        ([5.0, 5.0], 1.0, [(0, 2)]),
        ([0.0, 40.0], 2.0, [(0, 1), (20, 1)]),
        ([0.0, 39.0], 1.0, [(0, 1), (39, 1)]),
        ([0.0, 0.004], 0.0002, [(0, 1), (20, 1)]),
        ([-3e9, 1e9], 2e8, [(0, 1), (20, 1)]),
    ],
)
def test_histogram_bins(spark, values, width, bins):
    cells = spark.createDataFrame([(v,) for v in values], "value double")
    assert one(stats.histogram_range(cells)).width == width
    assert [(r.bin, r.n) for r in stats.histogram(cells).collect()] == bins


def test_directions(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)], "u double, v double")
    degrees = wind.direction(F.col("u"), F.col("v"))
    found = [tuple(r) for r in rows.select(F.round(degrees, 9), wind.compass(degrees)).collect()]
    assert found == [(90.0, "E"), (0.0, "N"), (270.0, "W"), (180.0, "S")]


def test_components_with_different_gaps(grid):
    u = grid([(0, 0, 0, 1.0), (0, 0, 1, NAN)])
    v = grid([(0, 0, 0, 1.0), (0, 0, 1, 3.0)])
    keys = ["time_idx", "lat_idx", "lon_idx"]
    for left in (u, u.where("value is not null")):
        row = one(winds.wind_stats(winds.pair_components(left, v, keys)))
        assert (row.n_speed, row.mean_u, row.mean_v) == (1, 1.0, 2.0)
        assert math.isclose(row.mean_speed, math.sqrt(2))


def test_storms_count_samples(spark):
    uv = spark.createDataFrame([(20.0, 0.0), (21.0, 0.0), (33.0, 0.0), (40.0, None)], "u double, v double")
    assert tuple(one(winds.storm_counts(uv))) == (2, 1, 33.0)


@pytest.mark.parametrize(
    "nt, steps",
    [
        (1, [0, 0, 0, 0]), (2, [0, 0, 0, 1]), (3, [0, 0, 1, 2]), (4, [0, 1, 2, 3]), (6, [0, 1, 2, 3, 4, 5]),
        (7, [0, 1, 2, 3, 4, 6]), (10, [0, 1, 3, 5, 7, 9]), (12, [0, 2, 4, 6, 8, 11]),
    ],
)
def test_story_positions(spark, nt, steps):
    row = spark.createDataFrame([(nt,)], "nt int").select(axis.story_positions(F.col("nt"))).first()
    assert row[0] == steps


def test_story_of_a_short_record(grid):
    cells = grid([(0, 0, 0, 1.0), (0, 0, 1, -2.0), (1, 0, 0, NAN), (1, 0, 1, NAN)])
    frames = sorted(views.tell_story(cells)["frames"].collect(), key=lambda r: r.step)
    assert [(r.step, r.time_idx) for r in frames] == [(0, 0), (1, 0), (2, 0), (3, 1)]
    assert [(r.symmetric_max, r.hot_lon) for r in frames] == [(2.0, 1.0)] * 3 + [(1.0, None)]
    assert frames[3].label == "2001-01-02 00:00:00"
    assert frames[1].caption == story.CAPTIONS[1]


def test_story_per_group_equals_single(grid):
    cells = grid([(t, 0, x, float((t * 7 + x * 3) % 11)) for t in range(9) for x in range(3)])
    keep = ["step", "time_idx", "symmetric_max", "hot_lon", "hot_value"]
    single = sorted(map(tuple, views.tell_story(cells)["frames"].select(*keep).collect()))
    grouped = cells.withColumn("g", F.explode(F.array(F.lit("a"), F.lit("b"))))
    steps = story.story_steps(grouped, by=["g"])
    frames = story.story_frames(story.story_slices(grouped, steps, by=["g"]), steps, by=["g"])
    for g in "ab":
        found = frames.where(F.col("g") == g)
        assert sorted(map(tuple, found.select(*keep).collect())) == single


def test_index_is_clipped(grid):
    cells = grid([(t, 0, 0, float(t)) for t in range(5)])
    assert one(axis.time_slice(cells, 99)).time_idx == 4
    assert one(axis.time_slice(cells, -3)).time_idx == 0
    assert axis.time_slice(cells, 99, clip=False).count() == 0
    plain = cells.drop("time_idx")
    assert one(axis.time_slice(plain, 99)).value == 4.0
    assert one(axis.time_slice(plain, 2)).value == 2.0


def test_static_fields_are_returned_whole(grid):
    cells = grid([(0, 0, 0, 1.0), (0, 0, 1, 2.0)]).drop("time", "time_idx")
    assert axis.time_slice(cells, 3).count() == 2
    moving = grid([(0, 0, 0, 1.0), (1, 0, 0, 1.0)]).withColumn("variable", F.lit("tas"))
    fixed = grid([(0, 0, 0, 1.0), (0, 0, 1, 2.0)]).withColumns(
        {"variable": F.lit("orog"), "time": F.lit(None).cast("timestamp_ntz"), "time_idx": F.lit(None).cast("int")}
    )
    both = moving.unionByName(fixed)
    found = axis.time_slice(both, 5, by=["variable"]).groupBy("variable").count().collect()
    assert {r.variable: r["count"] for r in found} == {"tas": 1, "orog": 2}


def test_time_axis_ranks_across_months(spark):
    times = ["2001-01-31 23:00:00", "2001-02-01 00:00:00", "2000-12-01 00:00:00", "2001-02-01 00:00:00"]
    df = spark.createDataFrame([(t, 1.0) for t in times], "time string, value double").withColumn("time", F.col("time").cast("timestamp_ntz"))
    found = sorted((r.time_idx, str(r.time)) for r in axis.time_axis(df).collect())
    assert found == [(0, "2000-12-01 00:00:00"), (1, "2001-01-31 23:00:00"), (2, "2001-02-01 00:00:00")]
    assert axis.with_time_index(df).where("time_idx = 2").count() == 2


def test_classifier(spark):
    expected = {
        "tas": "temperature", "pr": "rainfall", "uas": "wind", "hurs": "humidity", "snw": "snow", "sst": "general",
        "surface_pressure": "rainfall", "prsn": "rainfall", "news": "wind", " T2M ": "temperature",
    }
    names = spark.createDataFrame([(n,) for n in expected], "variable string")
    assert {r.variable: r.category for r in catalog.with_category(names).collect()} == expected


def test_first_match_follows_file_order(spark):
    listed = spark.createDataFrame(
        [("d", "v10", 0), ("d", "u10", 1), ("d", "uas", 2), ("d", "PRECIP", 3), ("e", "sst", 0)],
        "dataset_id string, variable string, ordinal int",
    )
    roles = {r.dataset_id: r for r in catalog.find_roles(listed).collect()}
    assert (roles["d"].u_variable, roles["d"].v_variable, roles["d"].rain_variable) == ("u10", "v10", "PRECIP")
    assert roles["d"].humidity_variable is None and "e" not in roles
    assert {r.dataset_id: r.found for r in catalog.find_variable(listed, classify.WIND_V).collect()} == {"d": "v10"}
    chosen = {r.dataset_id: r.variable for r in catalog.choose_variable(listed, override="absent", chosen="uas").collect()}
    assert chosen == {"d": "uas", "e": "sst"}


def test_outlines(spark):
    ring = [(0.0, 0.0), (90.0, 0.0), (0.0, 90.0), (0.0, 0.0)]
    table = spark.createDataFrame(
        [("one", [ring]), ("two", [ring, ring[:2]]), ("none", None)], "name string, rings array<array<struct<lon:double,lat:double>>>"
    )
    found = boundary.outline_vertices(table).collect()
    assert len(found) == 4 + 6
    assert {(r.name, r.part) for r in found} == {("one", 0), ("two", 0), ("two", 1)}
    east = next(r for r in found if r.lon == 90.0)
    assert (round(east.x, 9), round(east.y, 9), round(east.z, 9)) == (0.0, 1.0, 0.0)


@pytest.mark.parametrize(
    "units, offset, expected",
    [
        ("days since 2000-01-01", 1.5, datetime(2000, 1, 2, 12)),
        ("hours since 1990-01-01 06:00:00", 0.25, datetime(1990, 1, 1, 6, 15)),
        ("Seconds Since 1970-1-1 00:00:0.0", 61.0, datetime(1970, 1, 1, 0, 1, 1)),
        ("minutes since 2000-01-01T00:00:00Z", -1.0, datetime(1999, 12, 31, 23, 59)),
        ("days since 2000-01-01 00:00 +02:00", 0.0, datetime(1999, 12, 31, 22)),
        ("days since 1-1-1", 730121.25, datetime(2000, 1, 1, 6)),
        ("days since 1582-10-15", 0.0, datetime(1582, 10, 15)),
        ("days since 1582-10-04", 1.0, datetime(1582, 10, 15)),
        ("days since 2001-02-30", 1.0, None),
        ("months since 2000-01-01", 1.0, None),
        ("mm/day", 1.0, None),
        ("days since 2000-01-01", NAN, None),
        ("days since 2000-01-01", 1e300, None),
    ],
)
def test_time_decoding(spark, units, offset, expected):
    row = spark.createDataFrame([(offset,)], "t double").select(calendar.decode_time(F.col("t"), units)).first()
    assert row[0] == expected


def test_model_calendars_stay_unknown(spark):
    row = spark.createDataFrame([(1.0,)], "t double").select(calendar.decode_time(F.col("t"), "days since 2000-01-01", "noleap")).first()
    assert row[0] is None


def test_time_labels(spark):
    steps = spark.createDataFrame(
        [("a", "2001-01-01"), ("a", "soon"), ("a", "2001-01-01 06:30:00.5"), ("b", "10"), ("b", "20.5")], "g string, raw string"
    )
    found = {(r.g, r.raw): r.label for r in story.time_labels(steps.where("g = 'a'"), "raw", ["g"]).collect()}
    assert found == {
        ("a", "2001-01-01"): "2001-01-01 00:00:00", ("a", "soon"): "NaT", ("a", "2001-01-01 06:30:00.5"): "2001-01-01 06:30:00.500000",
    }
    raw = story.time_labels(spark.createDataFrame([("first",), ("second",)], "raw string"), "raw")
    assert sorted(r.label for r in raw.collect()) == ["first", "second"]


def test_missing_roles_are_named(grid):
    cells = grid([(0, 0, 0, 1.0)])
    with pytest.raises(MissingRole):
        cube.hotspot(cells.drop("lat"))
    with pytest.raises(MissingRole):
        ser.annual_total(cells.drop("time"))
    with pytest.raises(MissingRole):
        tables.ingest_table(cells.drop("value"))
    assert GridSpec.infer(cells.withColumnRenamed("time", "TIME")).time == "TIME"


def test_ingest_of_text_times(spark):
    raw = spark.createDataFrame([("2001-02-03", NAN), ("?", 2.0)], "time string, value double")
    rows = tables.ingest_table(raw).orderBy("value").collect()
    assert [(r.time, r.value) for r in rows] == [(datetime(2001, 2, 3), None), (None, 2.0)]


def test_axis_lookup(spark, grid):
    lats = spark.createDataFrame([(0, -10.0), (1, 10.0)], "lat_idx int, lat double")
    found = cube.attach_axis(grid([(0, 1, 0, 1.0)]).drop("lat"), lats, "lat_idx")
    assert one(found).lat == 10.0
