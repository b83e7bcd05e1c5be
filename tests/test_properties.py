"""Properties over many random series and fields, each checked in one job against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graticule.functions import sphere
from graticule.operators import axis, cube, indices, stats


def brute_streak(values, limit=1.0):
    dry = [v < limit for v in values if v is not None]
    runs = [len(list(g)) for is_dry, g in itertools.groupby(dry) if is_dry]
    return max(runs, default=0) if dry else None


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(11)
    found = {}
    for name in range(250):
        n, p, gap = rng.choice([1, 5, 63, 64, 65, 130, 300]), rng.choice([0, 0.02, 0.5, 0.97, 1]), rng.choice([0, 0.3])
        found[name] = [None if rng.random() < gap else (0.0 if rng.random() < p else float(rng.randint(1, 9))) for _ in range(n)]
    rows = [(name, i, v) for name, values in found.items() for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "name int, time_idx int, value double").withColumn(
        "time", F.expr("timestamp_ntz'2000-01-01'") + F.make_dt_interval(F.col("time_idx"))
    ).persist()
    yield found, table
    table.unpersist()


@pytest.mark.parametrize("drop, block", [([], 4096), ([], 2), (["time_idx"], 4096)])
def test_streaks(many, monkeypatch, drop, block):
    monkeypatch.setattr(indices, "BLOCK", block)
    found, table = many
    expected = {k: s for k, values in found.items() if (s := brute_streak(values)) is not None}
    streaks = indices.longest_dry_streak(table.drop(*drop), by=["name"]).collect()
    assert {r.name: r.longest_dry_streak for r in streaks} == expected


def test_extremes(many):
    found, table = many
    rows = {r.name: r for r in indices.extremes(table, by=["name"], hot_above=5, tropical_above=2).collect()}
    for name, values in found.items():
        present = [v for v in values if v is not None]
        if not present:
            assert name not in rows
            continue
        first = lambda v: values.index(v)
        days = [(rows[name].hottest_date.toordinal() - 730120), (rows[name].coldest_date.toordinal() - 730120)]
        assert days == [first(max(present)), first(min(present))]
        assert (rows[name].hot_days, rows[name].tropical_nights) == (sum(v > 5 for v in present), sum(v > 2 for v in present))


def test_histogram_counts_add_up(many):
    found, table = many
    summed = stats.histogram(table, by=["name"]).groupBy("name").agg(F.sum("n").alias("n"), F.max("bin").alias("last"))
    rows = {r.name: r for r in summed.collect()}
    for name, values in found.items():
        n = sum(v is not None for v in values)
        assert n == 0 and name not in rows or (rows[name].n == n and rows[name].last < 40)


def test_constant_grid_has_constant_mean(spark):
    cells = spark.range(6000).selectExpr("cast(id div 60 as int) time_idx", "cast(id % 60 div 10 as double) lat", "cast(id % 10 as double) lon", "2.5D value")
    assert cube.spatial_mean(cells).where("value <> 2.5").count() == 0


def test_sphere_has_radius_one(spark):
    points = spark.range(-90, 91).crossJoin(spark.range(-180, 181, 7).toDF("lon"))
    xyz = points.select(*[c.alias(n) for n, c in sphere.unit_sphere(F.col("id"), F.col("lon")).items()])
    assert xyz.where(F.abs(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 - 1) > 1e-12).count() == 0


def test_story_positions_are_even(spark):
    rows = spark.range(1, 20_001).select(F.col("id").cast("int").alias("nt"))
    steps = rows.select("nt", axis.story_positions(F.col("nt")).alias("s")).collect()
    for r in steps:
        n = min(6, max(4, r.nt))
        assert r.s == [k * (r.nt - 1) // (n - 1) for k in range(n)]


def test_population_deviation(many):
    found, table = many
    rows = {r.name: r for r in stats.global_stats(table, by=["name"]).collect()}
    for name, values in found.items():
        present = [v for v in values if v is not None]
        if present:
            mean = sum(present) / len(present)
            std = math.sqrt(sum((v - mean) ** 2 for v in present) / len(present))
            assert math.isclose(rows[name].std, std, abs_tol=1e-9)
