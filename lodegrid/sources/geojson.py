"""GeoJSON and Esri JSON to flat point rows, polygons and lines, from files or from a text column."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def geometry_type() -> str:
    return "struct<type:string,coordinates:string>"


def feature_type(properties: str) -> str:
    return f"struct<type:string,id:string,geometry:{geometry_type()},properties:{properties}>"


def _point(geometry: Column) -> tuple[Column, Column]:
    """Coordinates stay text until the kind is known, since their nesting differs by kind."""
    pair = F.from_json(geometry["coordinates"], "array<double>")
    ok = (geometry["type"] == "Point") & (F.size(pair) >= 2)
    return F.when(ok, F.element_at(pair, 1)), F.when(ok, F.element_at(pair, 2))


def features_from_text(docs: DataFrame, text: str, properties: str, keep: list[str] | None = None) -> DataFrame:
    """Features of documents in any wrapping: collection, single feature, plain list or bare geometry."""
    feature = feature_type(properties)
    wide = f"struct<type:string,features:array<{feature}>,geometry:{geometry_type()},properties:{properties},coordinates:string>"
    body = F.trim(F.col(text))
    as_list = F.when(body.startswith("["), F.from_json(body, f"array<{feature}>"))
    as_object = F.from_json(F.when(body.startswith("{"), body), wide)
    kind = F.col("_o.type")
    none = F.lit(None).cast("string").alias("id")
    single = F.struct(kind.alias("type"), none, F.col("_o.geometry").alias("geometry"), F.col("_o.properties").alias("properties"))
    bare = F.struct(
        F.lit("Feature").alias("type"), none, F.struct(kind.alias("type"), F.col("_o.coordinates").alias("coordinates")).alias("geometry"),
        F.lit(None).cast(properties).alias("properties"))
    # Struct field names of the branches agree with the feature type by position.
    pick = F.when(F.col("_l").isNotNull(), F.col("_l")).when(kind == "FeatureCollection", F.col("_o.features")).when(
        kind == "Feature", F.array(single)).when(F.col("_o.coordinates").isNotNull(), F.array(bare))
    rows = docs.withColumns({"_l": as_list, "_o": as_object}).select(
        *(keep or []), F.posexplode(pick).alias("position", "_f"))
    return rows.select(*(keep or []), "position", F.col("_f.id").alias("feature_id"),
                       F.col("_f.geometry").alias("geometry"), F.col("_f.properties").alias("properties"))


def point_rows(features: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Point features with their properties as columns; other kinds are left out."""
    lon, lat = _point(F.col("geometry"))
    return features.select(*(keep or []), lon.alias("lon"), lat.alias("lat"), "properties.*").where("lon is not null and lat is not null")


def _nested(depth: int) -> str:
    return "array<" * depth + "double" + ">" * depth


def _vertices(ring: Column) -> Column:
    return F.transform(F.filter(ring, lambda v: F.size(v) >= 2), lambda v: F.struct(F.element_at(v, 1).alias("x"), F.element_at(v, 2).alias("y")))


def _closed(ring: Column) -> Column:
    """The ring with its first vertex again at the end, where it is not there already."""
    vertices = _vertices(ring)
    return F.when(F.try_element_at(vertices, F.lit(1)) == F.try_element_at(vertices, F.lit(-1)), vertices).otherwise(
        F.concat(vertices, F.slice(vertices, 1, 1)))


def polygon_rows(features: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Polygon and MultiPolygon features as ``parts`` (per part its outer ring and holes), with their properties as columns."""
    g = F.col("geometry")
    single = F.array(F.from_json(g["coordinates"], _nested(3)))
    parts = F.when(g["type"] == "Polygon", single).when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], _nested(4)))
    closed = F.transform(parts, lambda rings: F.transform(rings, _closed))
    return features.select(*(keep or []), closed.alias("parts"), "properties.*").where("parts is not null")


def line_rows(features: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """LineString and MultiLineString features as ``parts`` (per part its vertices), with their properties as columns."""
    g = F.col("geometry")
    single = F.array(F.from_json(g["coordinates"], _nested(2)))
    parts = F.when(g["type"] == "LineString", single).when(g["type"] == "MultiLineString", F.from_json(g["coordinates"], _nested(3)))
    return features.select(*(keep or []), F.transform(parts, _vertices).alias("parts"), "properties.*").where("parts is not null")


def skipped_kinds(features: DataFrame) -> DataFrame:
    """Counts of features that are no usable point, so nothing is dropped silently."""
    lon, _ = _point(F.col("geometry"))
    return features.where(lon.isNull()).groupBy(F.coalesce("geometry.type", F.lit("no geometry")).alias("kind")).count()


def read_feature_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A collection written one feature per line; such files split over many tasks."""
    line = F.regexp_replace(F.trim("value"), ",$", "")
    lines = spark.read.text(path).where(F.col("value").startswith('{"type":"Feature",'))
    parsed = F.from_json(line, feature_type(properties))
    return lines.select(parsed.alias("_f")).select(
        F.col("_f.id").alias("feature_id"), F.col("_f.geometry").alias("geometry"), F.col("_f.properties").alias("properties"))


def read_documents(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Whole documents of any layout, one task per file."""
    docs = spark.read.text(path, wholetext=True).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return features_from_text(docs, "value", properties, ["source_file"])


def esri_features(docs: DataFrame, text: str, attributes: str, keep: list[str] | None = None) -> DataFrame:
    """Esri JSON pages to GeoJSON geometry: points as they are, every ring as its own polygon."""
    schema = f"struct<geometryType:string,features:array<struct<attributes:{attributes},geometry:struct<x:double,y:double,rings:array<array<array<double>>>>>>>"
    rows = docs.select(*(keep or []), F.from_json(text, schema).alias("_d")).select(
        *(keep or []), F.posexplode("_d.features").alias("position", "_f"))
    g = F.col("_f.geometry")
    point = F.when(g["x"].isNotNull() & g["y"].isNotNull(), F.struct(
        F.lit("Point").alias("type"), F.to_json(F.array(g["x"], g["y"])).alias("coordinates")))
    rings = F.when(g["rings"].isNotNull(), F.struct(
        F.lit("MultiPolygon").alias("type"), F.to_json(F.transform(g["rings"], lambda r: F.array(r))).alias("coordinates")))
    out = rows.select(*(keep or []), "position", g["x"].alias("lon"), g["y"].alias("lat"), F.coalesce(point, rings).alias("geometry"),
                      F.col("_f.attributes").alias("properties"))
    # a point without both coordinates is dropped, a feature without any geometry is kept
    return out.where(g_is_usable())


def g_is_usable() -> Column:
    return F.col("geometry").isNotNull() | (F.col("lon").isNull() & F.col("lat").isNull())
