"""Raster pixels to grid cells: modal value per cell, and one wide row per cell over several grids."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.functions import grid as g
from lodegrid.functions.scalars import round_dp


def pixel_centres(xmin: Column, ymax: Column, cell_x: Column, cell_y: Column, col: Column, row: Column):
    """Centre of a pixel; rows count from the top."""
    return xmin + (col + 0.5) * cell_x, ymax - (row + 0.5) * cell_y


def pixels_to_cells(pixels: DataFrame, lon: Column, lat: Column, res: int) -> DataFrame:
    return pixels.withColumn("_l", g.locate(lon, lat, F.lit(res))).withColumns(
        {"col": F.col("_l.col"), "row": F.col("_l.row")}).drop("_l")


def modal_value(pixels: DataFrame, attributes: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent group per cell with its count and the cell's total of declared pixels.

    Values missing from ``attributes`` (value, label) are nodata. A grid whose values are all labelled
    groups by label, so two codes of one unit vote together; else it groups by the raw code. A tie goes to
    the lowest group.
    """
    labelled = attributes.agg(F.count("*") == F.count(F.nullif(F.trim("label"), F.lit("")))).scalar()
    code = F.format_string("%012d", F.col("value").cast("bigint"))
    group = F.when(labelled, F.col("label")).otherwise(code)
    votes = pixels.join(attributes.select("value", "label"), "value").withColumn("_g", group)
    counts = votes.groupBy(*keys, "_g").agg(F.count("*").alias("_n"), F.min("value").alias("_code"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_g").alias("g"), F.col("_code").alias("code")))
    out = counts.groupBy(*keys).agg(best.alias("_b"), F.sum("_n").alias("total_count"))
    return out.select(
        *keys, F.when(labelled, F.col("_b.g")).otherwise(F.col("_b.code").cast("string")).alias("modal"),
        (-F.col("_b.n")).alias("modal_count"), "total_count",
        round_dp(-F.col("_b.n") / F.col("total_count"), 4).alias("modal_frac"))


def wide_cells(layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Every cell seen by any layer once, one column per layer; one shuffle over the tagged union."""
    tagged = [df.select(*keys, F.lit(name).alias("_layer"), "modal", "modal_frac") for name, df in layers.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    pick = lambda name, c: F.max(F.when(F.col("_layer") == name, F.col(c)))
    aggs = [pick(name, "modal").alias(name) for name in layers] + [
        pick(name, "modal_frac").alias(f"{name}_frac") for name in layers]
    return rows.groupBy(*keys).agg(*aggs)
