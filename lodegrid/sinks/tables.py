"""Writing results: GeoJSON lines, bounds, run records. Tables that change are in ``tablelog``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid import fixed


# --- GeoJSON ------------------------------------------------------------------------------------
def point_feature(lon: Column, lat: Column, properties: Column, feature_id: Column | None = None) -> Column:
    parts = [F.lit("Feature").alias("type")]
    if feature_id is not None:
        parts.append(feature_id.cast("string").alias("id"))
    parts += [F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), properties.alias("properties")]
    return F.to_json(F.struct(*parts))


def polygon_feature(ring: Column, properties: Column, feature_id: Column) -> Column:
    """``ring`` is a GeoJSON geometry as text."""
    return F.concat(F.lit('{"type":"Feature","id":"'), feature_id, F.lit('","geometry":'), ring, F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def content_fingerprint(rows: DataFrame, text: str) -> DataFrame:
    """Order-free fingerprint of a text column: two exact integer sums over row hashes."""
    h = F.xxhash64(F.col(text))
    return rows.agg(
        F.count("*").alias("rows"), F.sum(h.cast("decimal(20,0)")).alias("sum1"),
        F.sum(F.xxhash64(F.col(text), F.lit(1)).cast("decimal(20,0)")).alias("sum2"))


def write_features(features: DataFrame, text: str, order: list[str], path: str) -> bool:
    """Sorted, one feature per line; left alone when the content is unchanged. True when written."""
    spark = features.sparkSession
    stamp = f"{path.rstrip('/')}.fingerprint"
    now = content_fingerprint(features, text)
    try:
        if now.exceptAll(spark.read.schema(now.schema).json(stamp)).isEmpty():
            return False
    except Exception as missing:  # no earlier output
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    features.orderBy(*order).select(F.col(text).alias("value")).write.mode("overwrite").text(path)
    now.coalesce(1).write.mode("overwrite").json(stamp)
    return True


# --- tables -------------------------------------------------------------------------------------
def with_bounds(segments: DataFrame, keys: list[str], tile_degrees: float = 1.0) -> DataFrame:
    """Bounds of each geometry from its segments, and the tile its bounds start in for partition pruning."""
    out = segments.groupBy(*keys).agg(
        F.min(F.least("ax", "bx")).alias("min_lon"), F.min(F.least("ay", "by")).alias("min_lat"),
        F.max(F.greatest("ax", "bx")).alias("max_lon"), F.max(F.greatest("ay", "by")).alias("max_lat"))
    return out.withColumns({
        "tile_lon": F.floor(F.col("min_lon") / tile_degrees).cast("int"), "tile_lat": F.floor(F.col("min_lat") / tile_degrees).cast("int")})


# --- run records --------------------------------------------------------------------------------
def forbidden_fields(schema: T.DataType, path: str = "") -> list[str]:
    """Names anywhere in a schema that must never be written."""
    found = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            here = f"{path}{f.name}"
            if f.name.lower() in fixed.SECRET_FIELDS:
                found.append(here)
            found += forbidden_fields(f.dataType, here + ".")
    elif isinstance(schema, T.ArrayType):
        found += forbidden_fields(schema.elementType, path)
    elif isinstance(schema, T.MapType):
        found += forbidden_fields(schema.valueType, path)
    return found


def run_documents(runs: DataFrame, cells: DataFrame, key: str = "run_id") -> DataFrame:
    """One record per run with its scored cells, without geometry. A run is one record by definition."""
    thin = cells.drop("geometry", "display_geometry")
    values = [c for c in thin.columns if c != key]
    listed = thin.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*sorted(values)))).alias("composite_cells"))
    return runs.join(listed, key, "left")


def write_runs(records: DataFrame, path: str, created: str = "created_at") -> None:
    bad = forbidden_fields(records.schema)
    if bad:
        raise ValueError(f"refusing to write run records: secret fields {bad}")
    records.withColumn("run_date", F.to_date(created)).write.mode("append").partitionBy("run_date").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
