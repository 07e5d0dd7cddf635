"""What a scorer was told about a cell, as a hash: so that a changed fact sends only its own cells back to be scored.

A fact table may hold any number of rows per cell. Each row gives two numbers from the hash of its values, and a cell's
part of a table is their count and exact sums: free of order, and made in parts that add up, so no list of rows is
ever put together. A cell's context is the hash over the sums of all its tables and of the tables of its area.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.session import shuffled

#: Between values, and in place of a value that is missing; no fact holds them.
BETWEEN, MISSING = "\u0001", "\u0002"


def row_text(columns: list[str]) -> Column:
    """All values of a row in the order of their names, kept apart."""
    return F.concat_ws(BETWEEN, *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in sorted(columns)])


def _number(digest: Column, place: int) -> Column:
    """Fifteen hex digits as a number."""
    return F.conv(F.substring(digest, place, 15), 16, 10).cast("decimal(38,0)")


def table_sums(facts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, table, n, sum1, sum2: one row per cell that has facts in the table."""
    values = [c for c in facts.columns if c not in keys]
    hashed = facts.select(*keys, F.sha2(row_text(values), 256).alias("_h"))
    return hashed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(_number(F.col("_h"), 1)).alias("sum1"), F.sum(_number(F.col("_h"), 16)).alias("sum2")).withColumn("table", F.lit(name))


def _combined(parts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Hash over the tables of a key, by name; there are as many rows per key as tables."""
    text = F.concat_ws(":", "table", F.col("n").cast("string"), F.col("sum1").cast("string"), F.col("sum2").cast("string"))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "|"), 256).alias(out))


def context_hashes(cells: DataFrame, keys: list[str], tables: dict[str, DataFrame], area_key: str, area_tables: dict[str, DataFrame],
                   told: Callable[[DataFrame], DataFrame] = lambda cells: cells) -> DataFrame:
    """keys and context_hash of every cell; without any fact it is the hash of nothing.

    ``area_tables`` are told for every cell of an area, so a change in them changes all its cells. Where cells stand for
    those of several areas, ``told`` turns them into the cells of all areas before facts of areas are added.
    """
    def union(found: dict[str, DataFrame], by: list[str]) -> DataFrame:
        parts = [table_sums(df, by, name).select(*by, "table", "n", "sum1", "sum2") for name, df in found.items()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every

    out = cells.select(*keys).distinct().join(shuffled(_combined(union(tables, keys), keys, "_cell")), keys, "left")
    out = told(out)
    out = out.join(shuffled(_combined(union(area_tables, [area_key]), [area_key], "_area")), area_key, "left")
    both = F.concat(F.coalesce("_cell", F.lit("")), F.lit("/"), F.coalesce("_area", F.lit("")))
    return out.select(*keys, F.sha2(both, 256).alias("context_hash"))


def cells_to_rescore(scored: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose context is not the one they were scored with, and cells never scored."""
    return now.join(shuffled(scored.select(*keys, "context_hash")), [*keys, "context_hash"], "left_anti").select(*keys)
