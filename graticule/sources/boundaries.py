"""Country boundaries in geographic WGS84 coordinates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.sources.shapefile import read_shapefile

RINGS = "array<array<struct<lon:double,lat:double>>>"
SCHEMA = f"name string, rings {RINGS}"
GEOMETRY = T.StructType().add("type", "string").add("coordinates", "string")
FEATURE = T.StructType().add("properties", T.MapType(T.StringType(), T.StringType())).add("geometry", GEOMETRY)

CUT = '"Feature"'  # the value that every feature has for its type
COLLECTION = T.StructType([T.StructField("features", T.ArrayType(FEATURE)), *FEATURE.fields])


def exterior_rings(kind: Column, coordinates: Column) -> Column:
    """Exterior rings of a Polygon or MultiPolygon. Holes are ignored; other geometries give NULL."""

    def ring(points: Column) -> Column:
        return F.transform(points, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))

    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return (
        F.when(kind == "Polygon", F.transform(F.slice(polygon, 1, 1), ring))
        .when(kind == "MultiPolygon", F.transform(multi, lambda part: ring(F.get(part, F.lit(0)))))
        .cast(RINGS)
    )


def whole_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is a JSON object of its own. Spark looks at it, not the driver."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(1)
    return not lines.where(F.get_json_object("value", "$.type").isNotNull()).isEmpty()


def split_collection(spark: SparkSession, path: str) -> DataFrame:
    """The features of collections, however long and however broken into lines: the files are cut where a feature says
    that it is one, so that several tasks read one object.

    Each feature must begin with its type, as writers have it. Text that is cut elsewhere, such as a property with the
    value "Feature", fails the job.
    """
    parts = spark.read.option("lineSep", CUT).text(path)
    opens = F.col("value").rlike(r"^\ufeff?\s*\{")  # what precedes the first feature of a file
    header = F.col("value").rlike(r'"features"\s*:\s*\[(\s*\{\s*"type"\s*:\s*$|\s*\])')
    between, last = F.col("value").rlike(r'\}\s*,\s*\{\s*"type"\s*:\s*$'), F.col("value").rlike(r"\}\s*\]\s*(,[\s\S]*)?\}\s*$")
    wrong = F.raise_error(F.concat(F.lit("not a collection of features that begin with their type: "), F.substring("value", 1, 80)))
    # NULL for a header; what follows the object is not parsed. Spark may parse before it filters, so headers must not fail.
    feature = F.when((opens & header) | (F.trim("value") == ""), F.lit(None)).when(~opens & (between | last), F.concat(F.lit('{"type":"Feature"'), "value"))
    whole = feature.otherwise(wrong.cast("string"))
    parsed = parts.select(F.from_json(whole, FEATURE, {"mode": "FAILFAST"}).alias("f")).where("f is not null")
    return parsed.select("f.properties", "f.geometry")


def read_geojson(spark: SparkSession, path: str, name: str = "NAME", per_line: bool | None = None, split: bool = False) -> DataFrame:
    """Reads GeoJSON: an object per line, which splits over tasks, or an object per file, which one task reads.

    Objects are features or whole FeatureCollections. Without ``per_line`` the first line decides. With ``split`` files are
    collections that several tasks read. Malformed text fails the job instead of giving no boundary.
    """
    if split:
        return named_rings(split_collection(spark, path), name)
    per_line = whole_lines(spark, path) if per_line is None else per_line
    parsed = spark.read.schema(COLLECTION).option("mode", "FAILFAST").option("multiLine", not per_line).json(path)
    alone = F.array(F.struct("properties", "geometry"))
    features = parsed.select(F.explode(F.when(F.col("features").isNotNull(), F.col("features")).otherwise(alone)).alias("f")).select("f.*")
    return named_rings(features, name)


def named_rings(features: DataFrame, name: str) -> DataFrame:
    return features.select(
        F.col("properties")[name].alias("name"),
        exterior_rings(F.col("geometry.type"), F.col("geometry.coordinates")).alias("rings"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def read_boundaries(
    spark: SparkSession, *paths: str, name: str = "NAME", per_line: bool | None = None, split: bool = False
) -> DataFrame:
    """Boundaries from the first path that exists, Parquet, shapefile or GeoJSON; an empty table when none does."""
    for path in paths:
        try:
            if path.endswith(".parquet"):
                return spark.read.schema(SCHEMA).parquet(path)
            if path.lower().endswith(".shp"):
                if not exists(spark, path):
                    continue
                return read_shapefile(spark, path, name)
            return read_geojson(spark, path, name, per_line, split)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], SCHEMA)
