"""ASCII raster exports to pixel and attribute rows: one file per task, checked counts, long format."""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The format pads every raster row to whole lines of five numbers (fixed value).
NUMBERS_PER_LINE = 5
PIXELS = "grid string, col int, row int, value int, x double, y double, declared bigint"
ATTRIBUTES = "grid string, value int, count bigint, label string"
_BLOCK_ROWS = 256


class RasterFormatError(ValueError):
    pass


def _header(lines: list[str]) -> dict:
    if not lines[0].startswith("EXP") or not lines[1].startswith("GRD"):
        raise RasterFormatError("not an exported grid")
    shape = re.match(r"\s*(\d+)\s+(\d+)\b", lines[2])
    if not shape:
        raise RasterFormatError("no shape in header")
    numbers = [[float(v) for v in lines[i].split()] for i in (3, 4, 5)]
    return {"cols": int(shape[1]), "rows": int(shape[2]), "dx": numbers[0][0], "dy": numbers[0][1],
            "xmin": numbers[1][0], "ymax": numbers[2][1]}


def _attributes(tail: str) -> list[tuple[int, int, str]] | None:
    """Records of the attribute table; None without a table, which is not the same as a table without records."""
    at = tail.rfind(".VAT")
    if at < 0:
        return None
    lines = tail[tail.rfind("\n", 0, at) + 1:].splitlines()
    counts = re.findall(r"(?<=\s)-?\d+(?=\s|$)", lines[0])
    expected = int(counts[-1]) if counts else 0
    rows = []
    for line in lines[1:]:
        m = re.match(r"\s*(-?\d+)\s+(-?\d+)(.*)$", line)
        if m:
            rows.append((int(m[1]), int(m[2]), m[3].strip()))
        elif rows:
            break
        if expected and len(rows) == expected:
            break
    if expected and len(rows) != expected:
        raise RasterFormatError(f"attribute table declares {expected} records, found {len(rows)}")
    return rows


def _split(content: bytes) -> tuple[dict, str, str]:
    text = bytes(content).decode("latin-1")
    lines = text.split("\n", 6)
    if len(lines) < 7:
        raise RasterFormatError("truncated header")
    body, mark, tail = lines[6].partition("EOG")
    if not mark:
        raise RasterFormatError("no end of grid")
    return _header(lines), body, tail


def _name(path: str) -> str:
    return re.sub(r"\.e00$", "", path.rsplit("/", 1)[-1], flags=re.I)


def _pixel_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            head, body, tail = _split(content)
            table = _attributes(tail)
            declared = {v for v, _, _ in table or ()}
            values = np.array(body.split(), dtype=np.int64)
            stride = math.ceil(head["cols"] / NUMBERS_PER_LINE) * NUMBERS_PER_LINE
            if values.size != head["rows"] * stride:
                raise RasterFormatError(f"{path}: {values.size} numbers, header implies {head['rows'] * stride}")
            grid = values.reshape(head["rows"], stride)[:, : head["cols"]]
            for top in range(0, head["rows"], _BLOCK_ROWS):
                block = grid[top: top + _BLOCK_ROWS]
                keep = np.ones(block.shape, bool) if table is None else np.isin(block, list(declared))
                r, c = np.nonzero(keep)
                if not len(r):
                    continue
                yield pd.DataFrame({
                    "grid": _name(path), "col": c.astype("int32"), "row": (r + top).astype("int32"),
                    "value": block[r, c].astype("int32"), "x": head["xmin"] + (c + 0.5) * head["dx"],
                    "y": head["ymax"] - (r + top + 0.5) * head["dy"], "declared": np.int64(len(declared))})


def _attribute_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = _attributes(_split(content)[2])
            if not rows:
                continue
            yield pd.DataFrame({
                "grid": [_name(path)] * len(rows), "value": [v for v, _, _ in rows], "count": [n for _, n, _ in rows],
                "label": [t for _, _, t in rows]}).astype({"value": "int32", "count": "int64"})


def parse_pixels(files: DataFrame) -> DataFrame:
    """Pixels whose value the attribute table declares (path, content); everything else is nodata."""
    return files.select("path", "content").mapInPandas(_pixel_batches, PIXELS)


def parse_attributes(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_attribute_batches, ATTRIBUTES)


def read_rasters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.e00").load(path)
    return parse_pixels(files), parse_attributes(files)


def count_mismatches(pixels: DataFrame, attributes: DataFrame) -> DataFrame:
    """Declared against read pixels per value; an empty result means the read is whole."""
    read = pixels.groupBy("grid", "value").agg(F.count("*").alias("read"))
    both = attributes.join(read, ["grid", "value"], "left").fillna(0, ["read"])
    return both.where(F.col("read") != F.col("count")).select("grid", "value", "count", "read")
