"""A geology store that is read by window: units, polygons and lines in the order of a space-filling curve.

A feature belongs to a level, the finest whose square is no smaller than the feature, and to the square of that level that
holds the lower left corner of its bounds; so it reaches into that square and the next ones east and north at most. Its key
is the square's number along the Z curve. Files are written in ranges of (level, key) and parted by level and by the
leading bits of the key, with the key and the bounds in every row, so that their statistics skip what the parts do not.

A window becomes a few key ranges per level (never more than ``MOST_RANGES``), which filter parts and files; the bounds
then decide. A range that holds more than the window costs reading, never rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.operators.lines import line_segments, trend_and_length
from lodegrid.operators.records import longest_description
from lodegrid.session import shuffled

LEVELS = 12
#: Leading bits of the key by which a level is parted.
PART_BITS = 6
MOST_RANGES = 16
_W, _S, _E, _N = fixed.ENVELOPE
_SIDE = max(_E - _W, _N - _S)
BOUNDS = ("min_lon", "min_lat", "max_lon", "max_lat")


def _spread(x: Column) -> Column:
    """Bits of a small integer, a zero between each and the next."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = F.shiftleft(x, shift).bitwiseOR(x).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def z_key(col: Column, row: Column) -> Column:
    """Number of a square along the curve."""
    return _spread(col.cast("bigint")).bitwiseOR(F.shiftleft(_spread(row.cast("bigint")), 1))


def with_place(features: DataFrame) -> DataFrame:
    """Adds level, z and block to features with bounds. What lies outside the envelope goes to the squares at its rim."""
    extent = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    fine = F.floor(F.log2(F.lit(_SIDE) / F.greatest(extent, F.lit(_SIDE / 2**LEVELS)))).cast("int")
    level = F.least(F.greatest(fine, F.lit(0)), F.lit(LEVELS))
    squares = F.call_function("shiftleft", F.lit(1), F.col("level"))
    at = lambda v, low: F.least(F.greatest(F.floor((F.col(v) - low) / _SIDE * squares).cast("int"), F.lit(0)), squares - 1)
    placed = features.withColumn("level", level).withColumn("z", z_key(at("min_lon", _W), at("min_lat", _S)))
    return placed.withColumn("block", F.call_function("shiftrightunsigned", F.col("z"), F.greatest(2 * F.col("level") - PART_BITS, F.lit(0))).cast("int"))


def key_ranges(level: int, w: float, s: float, e: float, n: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys of a level whose squares can hold a feature that meets the window."""
    squares = 1 << level
    at = lambda v, low: min(max(int((v - low) // (_SIDE / squares)), 0), squares - 1)
    # One square more to the west and south, as features reach that far.
    c0, c1, r0, r1 = max(at(w, _W) - 1, 0), at(e, _W), max(at(s, _S) - 1, 0), at(n, _S)
    found: list[tuple[int, int]] = []

    def walk(col: int, row: int, size: int, first: int) -> None:
        if col > c1 or row > r1 or col + size <= c0 or row + size <= r0:
            return
        if size == 1 or (col >= c0 and row >= r0 and col + size - 1 <= c1 and row + size - 1 <= r1):
            found.append((first, first + size * size - 1))
            return
        half = size // 2
        for i, (x, y) in enumerate(((0, 0), (half, 0), (0, half), (half, half))):
            walk(col + x, row + y, half, first + i * half * half)

    walk(0, 0, squares, 0)
    merged: list[list[int]] = []
    for a, b in found:
        if merged and a == merged[-1][1] + 1:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    while len(merged) > most:  # the smallest gap is read over
        k = min(range(1, len(merged)), key=lambda i: merged[i][0] - merged[i - 1][1])
        merged[k - 1][1] = merged.pop(k)[1]
    return [(a, b) for a, b in merged]


def _write(features: DataFrame, path: str, order: str) -> None:
    placed = with_place(features).repartitionByRange("level", "z", order).sortWithinPartitions("level", "block", "z")
    placed.write.mode("overwrite").partitionBy("level", "block").parquet(path)


def _bounds(segments: DataFrame, key: str) -> DataFrame:
    return segments.groupBy(key).agg(
        F.min(F.least("ax", "bx")).alias("min_lon"), F.min(F.least("ay", "by")).alias("min_lat"),
        F.max(F.greatest("ax", "bx")).alias("max_lon"), F.max(F.greatest("ay", "by")).alias("max_lat"))


def bounded_polygons(polygons: DataFrame) -> DataFrame:
    """Polygons with the bounds of their outer ring; those without a vertex are left out."""
    outer = polygons.select("poly_id", F.array(F.col("rings")[0]).alias("_outer"))
    return polygons.join(shuffled(_bounds(line_segments(outer, ["poly_id"], "_outer"), "poly_id")), "poly_id")


def measured_lines(lines: DataFrame) -> DataFrame:
    """Lines with their bounds, trend and length; those without a vertex are left out."""
    segments = line_segments(lines, ["line_id"])
    return lines.join(shuffled(_bounds(segments, "line_id")), "line_id").join(shuffled(trend_and_length(segments, ["line_id"])), "line_id")


def write_store(path: str, units: DataFrame, polygons: DataFrame, lines: DataFrame) -> None:
    """Three tables below ``path``.

    unit: (unit, name, lithology, description, ord), one row per label, the fullest description. poly: (poly_id, unit, rings). line: (line_id,
    kind, name, parts) with trend and length measured in the equal-area plane; a point has no trend and length 0. Features without a
    vertex have no bounds and are left out.
    """
    longest_description(units, "unit", "description", "ord").write.mode("overwrite").parquet(f"{path}/unit")
    _write(bounded_polygons(polygons), f"{path}/poly", "poly_id")
    _write(measured_lines(lines), f"{path}/line", "line_id")


def read_window(spark: SparkSession, path: str, table: str, w: float, s: float, e: float, n: float) -> DataFrame:
    """Features of a store's table (poly or line) whose bounds meet the window, borders included."""
    wanted = F.lit(False)
    for level in range(LEVELS + 1):
        shift = max(2 * level - PART_BITS, 0)
        ranges = key_ranges(level, w, s, e, n)
        blocks = sorted({k for a, b in ranges for k in range(a >> shift, (b >> shift) + 1)})
        keys = F.lit(False)
        for a, b in ranges:
            keys = keys | F.col("z").between(a, b)
        wanted = wanted | ((F.col("level") == level) & F.col("block").isin(blocks) & keys)
    meets = (F.col("min_lon") <= e) & (F.col("max_lon") >= w) & (F.col("min_lat") <= n) & (F.col("max_lat") >= s)
    return spark.read.parquet(f"{path}/{table}").where(wanted & meets).drop("level", "block", "z")


def with_unit(polygons: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Polygons with what the store knows of their unit."""
    return polygons.join(spark.read.parquet(f"{path}/unit").select("unit", F.col("name").alias("unit_name"), "description"), "unit", "left")
