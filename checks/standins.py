"""Stand-in grids derived from the given tables.

Their values are multiples of 1/64 or whole numbers, so that sums are exact in any order of addition. Rows are
aggregated before they are joined or shuffled: no single customer, part or user decides the size of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graticule.sources.tables import ingest_table


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Its footer is read for the schema once, not once per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def _place(key: str, lon_steps: str = "") -> list[Column]:
    lat = f"cast(-60 + 30 * ({key} % 5) as double) as lat"
    lon = f"cast(-144 + 72 * (({key} div 5){lon_steps}) as double) as lon"
    return [F.expr(lat), F.expr(lon)]


def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily over several years: the dearest order per day and nation."""
    dearest = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("time"))
        .agg(F.max("o_totalprice").alias("price"))
    )
    nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        dearest.join(nations, F.col("o_custkey") == F.col("c_custkey"))
        .select("time", *_place("c_nationkey"), "price")
        .groupBy("time", "lat", "lon")
        .agg((F.floor(F.max("price") * 64 / 10000).cast("double") / 64).alias("value"))
    )


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By minute over one month: the event values per minute and place."""
    minute = F.expr("ts - make_dt_interval(0, 0, 0, extract(second from ts))").alias("time")
    cents = F.rint(F.col("value") * 100).cast("bigint").alias("cents")
    return (
        table(spark, sf_dir, "events")
        .select(minute, *_place("user_id", " % 5"), cents)
        .groupBy("time", "lat", "lon")
        .agg(F.expr("cast((sum(cents) * 64) div 100 as double) / 64").alias("value"))
    )


def atmosphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily wind components and humidity, one column each."""
    percent = "cast(rint({} * 100) as int)".format
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_shipdate").cast("date").alias("time"),
            *_place("l_suppkey", " % 5"),
            "l_quantity",
            F.expr(percent("l_tax")).alias("tax"),
            F.expr(percent("l_discount")).alias("discount"),
        )
        .groupBy("time", "lat", "lon")
        .agg(
            (F.min("l_quantity") - 25.5).alias("u"),
            ((F.min("tax") - 4) * 6).cast("double").alias("v"),
            (F.sum("discount").cast("double") * 10 / F.count("*")).alias("hurs"),
        )
    )


def humidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atmosphere(spark, sf_dir).select("time", "lat", "lon", F.col("hurs").alias("value"))


def gappy_humidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Humidity with NaN for dry and infinity for very humid cells, as a file would hold it, then ingested."""
    raw = humidity(spark, sf_dir).withColumn(
        "value",
        F.when(F.col("value") < 30, F.lit(float("nan")))
        .when(F.col("value") > 90, F.lit(float("inf")))
        .otherwise(F.col("value")),
    )
    return ingest_table(raw)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube with a further dimension."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_shipdate").cast("date").alias("time"), F.col("l_linenumber").alias("lev"),
                *_place("l_suppkey", " % 5"), "l_quantity")
        .groupBy("time", "lev", "lat", "lon")
        .agg(F.max("l_quantity").alias("value"))
    )


# Variable names of the seven runs below, by run number modulo 4.
RUN_VARIABLES = [("tas", "pr", "sfcWind"), ("uas", "vas", "hurs"), ("hurs", "u10", "precip"), ("snw", "sst", "prsn")]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven datasets with three variables each, in one long table."""
    run = F.col("l_linenumber")

    def name(slot: int) -> Column:
        chosen = F.lit(RUN_VARIABLES[-1][slot])
        for k in range(len(RUN_VARIABLES) - 1):
            chosen = F.when(run % len(RUN_VARIABLES) == k, F.lit(RUN_VARIABLES[k][slot])).otherwise(chosen)
        return chosen

    cells = (
        table(spark, sf_dir, "lineitem")
        .select(run, F.col("l_shipdate").cast("date").alias("time"), *_place("l_suppkey", " % 5"),
                "l_quantity", "l_discount", "l_tax")
        .groupBy("l_linenumber", "time", "lat", "lon")
        .agg(F.min("l_quantity").alias("a"), F.min("l_discount").alias("b"), F.min("l_tax").alias("c"))
    )
    slots = [F.struct(name(i).alias("variable"), F.col(c).alias("value")) for i, c in enumerate("abc")]
    return cells.select(
        F.concat(F.lit("run"), run.cast("string")).alias("dataset_id"), "time", "lat", "lon", F.inline(F.array(*slots))
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a variable name, with its place in the document."""
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("dataset_id"), F.posexplode(found).alias("ordinal", "variable")
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features around the customers: polygons with a hole, two-part polygons, points, and no geometry."""
    key = F.col("c_custkey")
    lon, lat = ((key % 360) - 180).cast("double"), ((key % 160) - 80).cast("double")

    def square(shift: float) -> Column:
        corners = [(0, 0), (1, 0), (1, 1), (0, 0)]
        return F.array(*[F.array(lon + (shift + dx), lat + dy) for dx, dy in corners])

    kind = F.element_at(F.array(*[F.lit(k) for k in ("Polygon", "MultiPolygon", "Point", "None")]), (key % 4).cast("int") + 1)
    coordinates = (
        F.when(kind == "Polygon", F.to_json(F.array(square(0.0), square(0.25))))
        .when(kind == "MultiPolygon", F.to_json(F.array(F.array(square(0.0)), F.array(square(3.0)))))
        .when(kind == "Point", F.to_json(F.array(lon, lat)))
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.when(kind != "None", kind).alias("kind"), coordinates.alias("coordinates")
    )
