"""KML, KMZ, GPX and GML documents to point rows with native XML parsing."""
from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.functions.scalars import collapse_space, iso_date

_PLACEMARK = ("struct<name:string,description:string,TimeStamp:struct<when:string>,Point:struct<coordinates:string>,"
              "LineString:struct<coordinates:string>,Polygon:struct<outerBoundaryIs:string>>")
# Folders nest; this many levels are opened.
_DEPTH = 4


def _folder_type(depth: int) -> str:
    inner = f",Folder:array<{_folder_type(depth - 1)}>,Document:array<{_folder_type(depth - 1)}>" if depth else ""
    return f"struct<name:string,Placemark:array<{_PLACEMARK}>{inner}>"


def _text(x: Column) -> Column:
    return collapse_space(F.coalesce(x, F.lit("")))


def kml_placemarks(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Placemarks with the name of the enclosing folder.

    The root document names the map and not a layer, so its name is not a folder; a nested document's is.
    """
    clean = F.regexp_replace(F.col(text), r"<(/?)(?:kml|gx):", "<$1")
    parsed = docs.select(*keep, F.from_xml(clean, _folder_type(_DEPTH)).alias("_n"))
    level = parsed.select(*keep, F.lit("").alias("folder"), F.col("_n").alias("_n"))
    found = None
    for depth in range(_DEPTH, -1, -1):
        here = level.select(*keep, "folder", F.explode("_n.Placemark").alias("_p"))
        found = here if found is None else found.unionByName(here)
        if depth == 0:
            break
        # The outermost Document only wraps the map.
        named = (lambda child: F.lit("")) if depth == _DEPTH else (
            lambda child: F.coalesce(F.nullif(_text(child["name"]), F.lit("")), F.col("folder")))
        doc = level.select(*keep, "folder", F.explode("_n.Document").alias("_c")).select(
            *keep, named(F.col("_c")).alias("folder"), F.col("_c").alias("_n"))
        sub = level.select(*keep, "folder", F.explode("_n.Folder").alias("_c")).select(
            *keep, F.coalesce(F.nullif(_text(F.col("_c.name")), F.lit("")), F.col("folder")).alias("folder"), F.col("_c").alias("_n"))
        level = doc.unionByName(sub)
    return found


def kml_points(placemarks: DataFrame, keep: list[str]) -> DataFrame:
    parts = F.split(F.trim("_p.Point.coordinates"), r"[,\s]+")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    out = placemarks.select(
        *keep, "folder", _text(F.col("_p.name")).alias("name"), _text(F.col("_p.description")).alias("description"),
        iso_date(F.col("_p.TimeStamp.when")).alias("date"), number(1).alias("lon"), number(2).alias("lat"))
    return out.where("lon is not null and lat is not null")


def kml_skipped(placemarks: DataFrame, keep: list[str]) -> DataFrame:
    """Lines, polygons and empty or unreadable placemarks, counted and not dropped silently."""
    has = lambda c: F.col(f"_p.{c}").isNotNull()
    kind = F.when(has("LineString"), "LineString").when(has("Polygon"), "Polygon").when(
        ~has("Point"), "no geometry").when(
        F.size(F.split(F.trim("_p.Point.coordinates"), r"[,\s]+")) < 2, "unparseable Point")
    return placemarks.withColumn("kind", kind).where("kind is not null").groupBy(*keep, "kind").count()


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return kml_placemarks(docs, "value", ["source_file"])


def unzip_members(archives: DataFrame, suffix: str = ".kml") -> DataFrame:
    """All members of zipped files (path, content) whose name ends with ``suffix``, as text rows."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(n for n in archive.namelist() if n.lower().endswith(suffix)):
                        text = archive.read(member).decode("utf-8-sig", errors="replace")
                        yield pd.DataFrame({"path": [path], "member": [member], "text": [text]})

    return archives.select("path", "content").mapInPandas(unpack, "path string, member string, text string")


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    files = unzip_members(spark.read.format("binaryFile").load(path))
    docs = files.withColumn("source_file", F.element_at(F.split("path", "/"), -1))
    return kml_placemarks(docs, "text", ["source_file"])


_WPT = "_lat:double,_lon:double,name:string,desc:string,cmt:string,sym:string,time:string"
_GPX = f"struct<wpt:array<struct<{_WPT}>>,trk:array<struct<name:string>>,rte:array<struct<name:string>>>"


def gpx_documents(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return docs.select(*keep, F.from_xml(F.col(text), _GPX).alias("_g"))


def gpx_points(parsed: DataFrame, keep: list[str]) -> DataFrame:
    w = parsed.select(*keep, F.explode("_g.wpt").alias("_w"))
    note = F.coalesce(F.nullif(_text(F.col("_w.desc")), F.lit("")), _text(F.col("_w.cmt")))
    out = w.select(*keep, _text(F.col("_w.name")).alias("name"), note.alias("description"), _text(F.col("_w.sym")).alias("symbol"),
                   iso_date(F.col("_w.time")).alias("date"), F.col("_w._lon").alias("lon"), F.col("_w._lat").alias("lat"))
    return out.where("lon is not null and lat is not null")


def gpx_skipped(parsed: DataFrame, keep: list[str]) -> DataFrame:
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return parsed.groupBy(*keep).agg(
        F.sum(F.greatest(F.lit(0), size("_g.trk"))).alias("tracks"), F.sum(F.greatest(F.lit(0), size("_g.rte"))).alias("routes"))


def resolve_axis_order(pos: Column, srs: Column) -> Column:
    """struct(lon, lat): the declared order, corrected when the latitude it gives cannot be one."""
    parts = F.split(F.trim(pos), r"[\s,]+")
    first, second = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    lat_first = F.coalesce(srs.rlike("(?i)^urn:(x-)?ogc:def:crs:EPSG:"), F.lit(False))
    lon = F.when(lat_first, second).otherwise(first)
    lat = F.when(lat_first, first).otherwise(second)
    swap = (F.abs(lat) > 90.0) & (F.abs(lon) <= 90.0)
    lon2, lat2 = F.when(swap, lat).otherwise(lon), F.when(swap, lon).otherwise(lat)
    return F.when((F.abs(lat2) <= 90.0) & (F.abs(lon2) <= 180.0), F.struct(lon2.alias("lon"), lat2.alias("lat")))


def gml_features(pages: DataFrame, text: str, fields: str, keep: list[str], element: str) -> DataFrame:
    """Members of landed feature pages. ``fields`` are the element's attributes; an exception report fails the job."""
    clean = F.regexp_replace(F.col(text), r"<(/?)\w+:", "<$1")
    schema = (f"struct<member:array<struct<{element}:struct<{fields},geometry:struct<Point:struct<"
              "_srsName:string,pos:string>>>>>>")
    bad = F.col(text).rlike("ExceptionReport")
    body = F.when(bad, F.raise_error(F.concat(F.lit("service exception: "), F.substring(F.col(text), 1, 500)))).otherwise(clean)
    rows = pages.select(*keep, F.from_xml(body, schema).alias("_d")).select(*keep, F.explode("_d.member").alias("_m"))
    point = F.col(f"_m.{element}.geometry.Point")
    out = rows.select(*keep, f"_m.{element}.*", resolve_axis_order(point["pos"], point["_srsName"]).alias("_at")).drop("geometry")
    return out.where("_at is not null").select("*", "_at.lon", "_at.lat").drop("_at")
