"""What the physical plans must look like on a stored grid."""

import re

import pytest
from pyspark.sql import functions as F

from graticule.operators import axis, cube, indices, series, stats, story, wind
from graticule.operators.groups import attach
from graticule.plans import views
from graticule.sources import colocated
from graticule.spec import MissingRole


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('grid')}/t"
    spark.range(0, 100 * 6 * 8, 1, 4).selectExpr(
        "cast(id div 48 as int) time_idx",
        "timestamp_ntz'2000-01-01' + make_dt_interval(cast(id div 48 as int)) time",
        "cast(id % 48 div 8 as int) lat_idx", "cast(id % 48 div 8 as double) lat",
        "cast(id % 8 as int) lon_idx", "cast(id % 8 as double) lon",
        "cast(pmod(xxhash64(id), 50) as double) value", "cast(id % 7 as double) spare",
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


def read_columns(text):
    return {c.split(":")[0] for c in re.search(r"ReadSchema: struct<([^>]*)>", text)[1].split(",")}


def test_annual_mean_reads_three_columns_and_combines_early(stored):
    text = plan(series.annual_mean_by_period(cube.spatial_mean(stored)))
    assert read_columns(text) == {"time_idx", "time", "value"}
    assert "partial_avg(value" in text and "Python" not in text and "Window" not in text


def test_no_operator_runs_python(stored):
    uv = stored.withColumns({"u": F.col("value"), "v": F.col("spare")})
    for df in (
        indices.longest_dry_streak(stored, by=["lat_idx", "lon_idx"], dry_below=20),
        indices.extremes(stored, by=["lat_idx", "lon_idx"]),
        stats.histogram(stored),
        stats.global_stats(stored),
        wind.wind_stats(uv),
        views.tell_story(stored)["frames"],
    ):
        text = plan(df)
        assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|CartesianProduct", text)
        assert "NestedLoopJoin" not in text


def test_slices_filter_in_the_scan(stored):
    assert re.search(r"PushedFilters: \[.*EqualTo\(time_idx,50\)", plan(axis.time_slice(stored, 50, clip=False)))
    assert re.search(r"EqualTo\(time_idx,ScalarSubquery", plan(axis.time_slice(stored, 50)))
    steps = story.story_steps(stored)
    assert re.search(r"Or\(.*EqualTo\(time_idx,ScalarSubquery", plan(story.story_slices(stored, steps)))


def test_absent_steps_read_nothing(stored):
    """Fewer steps than filters: the filters without a step match no row of a stored table."""
    compared = views.compare(stored, 3, 7)["cells"].groupBy("slice", "time_idx").count().collect()
    assert sorted(map(tuple, compared)) == [("A", 3, 48), ("B", 7, 48)]
    short = views.tell_story(stored.where("time_idx < 2"))["cells"].groupBy("step", "time_idx").count().collect()
    assert sorted(map(tuple, short)) == [(0, 0, 48), (1, 0, 48), (2, 0, 48), (3, 1, 48)]


def test_streak_per_cell_shuffles_words_not_rows(stored):
    df = indices.longest_dry_streak(stored, by=["lat_idx", "lon_idx"], dry_below=20)
    text = plan(df)
    assert "partial_bit_or" in text
    for keys in re.findall(r"Window \[.*?\], \[(.*?)\], \[", text):
        assert "lat_idx" in keys, "a window without the cell would sort all cells in one task"


def test_missing_keys_have_a_way_without_broadcast(stored):
    limits = stored.groupBy("lat_idx").agg(F.max("value").alias("top"))
    spread = ["time_idx", "lon_idx"]
    small = attach(stored, limits, ["lat_idx"], spread)
    large = attach(stored, limits, ["lat_idx"], spread, broadcast_rows=0)
    assert "BroadcastHashJoin" in plan(small) and "__salt" in plan(large)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    by_lat = [stats.histogram(stored, by=["lat_idx"], broadcast_rows=n).collect() for n in (0, 100)]
    assert by_lat[0] == by_lat[1]


def test_wide_wind_needs_no_join(stored):
    uv = stored.withColumns({"u": F.col("value"), "v": F.col("spare")})
    assert "Join" not in plan(wind.storm_counts(uv))


def test_many_groups_move_no_raw_rows(stored):
    """Beyond the broadcast bound extremes and hotspots aggregate in one pass: partial results are all that is shuffled."""
    by = ["lat_idx", "lon_idx"]
    for found, few in (
        (indices.extremes(stored, by=by, broadcast_rows=0), indices.extremes(stored, by=by)),
        (cube.hotspot(stored, by=["time_idx"], broadcast_rows=0), cube.hotspot(stored, by=["time_idx"])),
    ):
        exchanges = re.findall(r"Exchange[^\n]*\n[^\n]*", plan(found))
        assert len(exchanges) == 1 and "partial_min_by" in plan(found) and "Join" not in plan(found)
        key = lambda r: tuple(map(str, r))
        assert sorted(found.collect(), key=key) == sorted(few.collect(), key=key)


def test_only_large_groups_are_dealt_in_parts(spark):
    """Facts are copied for the groups that hold much of the table, not for all."""
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, -1, id) as g", "id", "double(id) as value")
    facts = rows.groupBy("g").agg({"value": "max"}).withColumnRenamed("max(value)", "top")
    joined = attach(rows, facts, ["g"], ["id"], broadcast_rows=0)
    assert joined.count() == 40_000 and joined.where("g = -1").where("top <> 39998").count() == 0
    spread = joined._jdf.queryExecution().toString()
    assert "__salt" in spread and joined.where("g <> -1 and top <> value").count() == 0


def test_grouped_slices_bound_the_scan(stored):
    """A slice by group filters by the range of its steps in the one scan that it needs."""
    text = plan(axis.time_slice(stored.withColumnRenamed("spare", "dataset"), 50, by=["dataset"]))
    assert re.search(r"GreaterThanOrEqual\(time_idx,50\)", text) and text.count("FileScan") == 1


def test_components_of_a_colocated_grid_meet_without_a_shuffle(spark, stored, tmp_path):
    long = stored.select("*", F.explode(F.array(F.lit("uas"), F.lit("vas"))).alias("variable")).withColumn("dataset_id", F.lit("d"))
    long = long.where("not (variable = 'vas' and time_idx = 7 and lat_idx = 0)").withColumn("value", F.expr("if(variable = 'vas', -value, value)"))
    colocated.write_colocated(long, "wind_cells", 4, path=f"file://{tmp_path}/t")
    found = spark.table("wind_cells")
    keys = colocated.cell_keys(found)
    assert keys == ["dataset_id", "time_idx", "lat_idx", "lon_idx"]
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        uv = wind.pair_from_long(found, "uas", "vas", keys)
        text = final_plan(uv)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "Exchange" not in text and text.count("Bucketed: true") >= 2
    rows = uv.collect()
    assert len(rows) == 4800 and sum(r.v is None for r in rows) == 8 and all(r.v is None or r.v == -r.u for r in rows)
    once = found.groupBy(*keys).agg(F.max(F.when(F.col("variable") == "uas", F.col("value"))).alias("u"))
    assert "Exchange" not in final_plan(once)
    with pytest.raises(MissingRole):
        colocated.cell_keys(found.drop("lat_idx"))
    colocated.write_colocated(long.where("false"), "no_cells", 4, path=f"file://{tmp_path}/e")
    assert spark.table("no_cells").count() == 0
