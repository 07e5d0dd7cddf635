"""From raster exports to the native cell table: pixels, modal values, wide cells, published with meta rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions import geo
from lodegrid.operators import raster
from lodegrid.sinks.tablelog import TableLog

#: Layer names of the build and the grids they come from (fixed values).
GRIDS = {"geol": "newageol", "fault": "newafaul", "fold": "newafold", "dike": "newadike"}


def native_cells(pixels: DataFrame, attributes: DataFrame, grids: dict[str, str] = GRIDS) -> DataFrame:
    """Cells over all grids, modal value of each; positions are UTM zone 11 on NAD27."""
    lon, lat = geo.nad27_utm_to_wgs84(F.col("x"), F.col("y"))
    placed = pixels.withColumns({"_lon": lon, "_lat": lat})
    cells = raster.pixels_to_cells(placed, F.col("_lon"), F.col("_lat"), fixed.WOFE_RESOLUTION).select("grid", "col", "row", "value")
    layers = {}
    for name, grid in grids.items():
        vat = attributes.where(F.col("grid") == grid).select("value", "label")
        layers[name] = raster.modal_value(cells.where(F.col("grid") == grid), vat, ["col", "row"])
    wide = raster.wide_cells(layers, ["col", "row"])
    code = lambda c: F.col(c).try_cast("int")
    return wide.select(
        "col", "row", F.col("geol").alias("geol_unit"), F.col("geol_frac").alias("geol_unit_frac"),
        code("fault").alias("fault_code"), code("fold").alias("fold_code"), F.col("dike").alias("dike_unit"))


def build(pixels: DataFrame, attributes: DataFrame, path: str, built_at: str) -> None:
    """Cells stored by coarse block, so an index window prunes files, with their meta rows in the same commit."""
    cells = native_cells(pixels, attributes).withColumn("block", F.floor(F.col("col") / 400).cast("int"))
    table = TableLog(cells.sparkSession, path, cells.schema, ["block", "col", "row"], part="block")
    table.publish(cells.repartition("block").sortWithinPartitions("col", "row"), {
        "built_at": built_at, "source": fixed.CITE_RASTER, "resolution_m": fixed.WOFE_RESOLUTION, "grid_tag": fixed.GRID_TAG})
