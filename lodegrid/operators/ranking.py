"""Ranks within a group that may hold a third of all rows.

A rank is a prefix sum. Rows are dealt out by range of (group, value), ties further by a hash of the row, so that no
group, and no value that many rows share, stays in one task. Rows are counted per range, the counts are summed over the
ranges before, and each row adds its place inside its range. Only a value that lies on the border of two ranges needs
more: there is one such value per border at most, so that list is no longer than the list of ranges.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions.scalars import round_dp, tier
from lodegrid.session import materialise

#: Rows of a group that are sorted in one task; what is larger is dealt out by range.
WHOLE = 1_000_000


def dealt_by_range(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows stored in ranges of ``order``, with the number of the range (_part), which grows with the order."""
    return materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def ranges(dealt: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Per group and range: rows in it (_inside), in the ranges before it (_before) and in the group (n), and ``extra`` aggregates."""
    parts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_inside"), *extra)
    group = Window.partitionBy(*keys)
    return parts.withColumns({"_before": F.sum("_inside").over(group.orderBy("_part")) - F.col("_inside"), "n": F.sum("_inside").over(group)})


def numbered(rows: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Rows with their number (from 1) in their group, as row_number gives it, and the rows of the group (n)."""
    dealt = dealt_by_range(rows, [*keys, *order])
    placed = dealt.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    both = placed.join(ranges(dealt, keys).drop("_inside"), [*keys, "_part"], "left")
    return both.withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def _across_borders(dealt: DataFrame, parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Position of each value that more than one range holds: one row per border of two ranges at most."""
    group = Window.partitionBy(*keys).orderBy("_part")
    shared = parts.withColumn("_next", F.lead("_lo").over(group)).where("_hi = _next").select(*keys, F.col("_hi").alias(value)).distinct()
    counts = dealt.join(F.broadcast(shared), [*keys, value], "left_semi").groupBy(*keys, value, "_part").agg(F.count("*").alias("_k"))
    counts = counts.join(parts.select(*keys, "_part", "_inside", "_before"), [*keys, "_part"])
    # In the first of its ranges such a value stands last.
    return counts.groupBy(*keys, value).agg(
        F.sum("_k").alias("_tied"), F.min_by(F.col("_before") + F.col("_inside") - F.col("_k"), "_part").alias("_below"))


def with_positions(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with below, tied, n, lowest and highest of their group; null values and rows of a null group have no position."""
    known, keys_, columns = F.col(value).isNotNull(), ["_known", *keys], rows.columns
    dealt = dealt_by_range(rows.withColumn("_known", known), [*keys_, value, F.xxhash64(*columns)])
    parts = ranges(dealt, keys_, F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    group = Window.partitionBy(*keys_)
    parts = parts.withColumns({"lowest": F.min("_lo").over(group), "highest": F.max("_hi").over(group)})
    inside = Window.partitionBy(*keys_, "_part").orderBy(value)
    placed = dealt.withColumns({"_rank": F.rank().over(inside), "_same": F.count("*").over(inside.rangeBetween(0, 0))})
    border = _across_borders(dealt, parts, keys_, value)
    placed = placed.join(parts.drop("_inside", "_lo", "_hi"), [*keys_, "_part"], "left").join(F.broadcast(border), [*keys_, value], "left")
    found = {
        "below": F.coalesce(F.col("_below"), F.col("_before") + F.col("_rank") - 1), "tied": F.coalesce("_tied", "_same"),
        "n": F.col("n"), "lowest": F.col("lowest"), "highest": F.col("highest"),
    }
    return placed.select(*columns, *[F.when(F.col("_known"), c).alias(k) for k, c in found.items()])


def placed(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with <value>_below, <value>_tied and <value>_n for each of ``values``, as ``with_positions`` finds them.

    Groups of up to ``WHOLE`` rows are sorted where they lie, by each value in turn, after one shuffle for all of them; only what is
    larger is dealt out by range. Rows of a null group are left out.
    """
    names = {v: {"below": f"{v}_below", "tied": f"{v}_tied", "n": f"{v}_n"} for v in values}
    rows = materialise(rows.dropna(subset=keys), "groups")
    crowded = materialise(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).select(*keys), "crowded")
    none, group, whole = crowded.isEmpty(), Window.partitionBy(*keys), rows
    if not none:  # at most one row for every WHOLE rows
        whole = rows.join(F.broadcast(crowded), keys, "left_anti")
    for v, out in names.items():
        order, known = group.orderBy(F.asc_nulls_last(v)), F.col(v).isNotNull()
        whole = whole.withColumns({
            out["below"]: F.when(known, F.rank().over(order) - 1), out["tied"]: F.when(known, F.count(v).over(order.rangeBetween(0, 0))),
            out["n"]: F.when(known, F.count(v).over(group))})
    if none:
        return whole
    large = rows.join(F.broadcast(crowded), keys, "left_semi")
    for v, out in names.items():
        large = with_positions(large, keys, v).withColumnsRenamed(out).drop("lowest", "highest")
    return whole.unionByName(large)


def rank_relative(cells: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Min-max stretch, midpoint percentile and tier of every cell within its area."""
    ranked = with_positions(cells, keys, score)
    spread = F.col("highest") - F.col("lowest")
    varied = spread > fixed.UNIFORM_EPSILON
    percentile = round_dp((F.col("below") + F.col("tied") / 2.0) / F.col("n"), 4)
    out = ranked.withColumns({
        "relative_score": F.when(varied, round_dp((F.col(score) - F.col("lowest")) / spread, 4)).otherwise(0.5),
        "percentile": percentile,
    })
    return out.withColumn("tier", F.when(varied, tier(F.col("percentile"))).otherwise("low")).drop(
        "lowest", "highest", "n", "below", "tied"
    )


def mid_rank(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """1-based rank, ties sharing the middle of their block."""
    ranked = with_positions(rows, keys, value)
    rank = F.col("below") + (F.col("tied") + 1) / 2.0
    return ranked.withColumn(out, rank).drop("lowest", "highest", "n", "below", "tied")


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str, places: int = 4) -> DataFrame:
    """Rank correlation with mid-ranks; null below three pairs or when a side is constant.

    Ranks are multiples of a half, so doubled ranks and their products are summed as exact integers.
    """
    ranked = mid_rank(mid_rank(pairs, keys, x, "_rx"), keys, y, "_ry")
    a, b = (F.floor(F.col(c) * 2 + 0.5) for c in ("_rx", "_ry"))
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("pairs"), *rank_sums(a, b))
    return sums.select(*keys, "pairs", rank_correlation(F.col("pairs"), places).alias("rho"))


def rank_sums(a: Column, b: Column) -> list[Column]:
    """Aggregates of doubled ranks that ``rank_correlation`` reads."""
    a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    product = lambda x, y: F.sum((x * y).cast("decimal(38,0)"))
    return [F.sum(a).alias("_sa"), F.sum(b).alias("_sb"), product(a, b).alias("_sab"), product(a, a).alias("_saa"), product(b, b).alias("_sbb")]


def rank_correlation(pairs: Column, places: int = 4) -> Column:
    n, sa, sb, sab, saa, sbb = (c.cast("double") for c in (pairs, *(F.col(k) for k in ("_sa", "_sb", "_sab", "_saa", "_sbb"))))
    cov, vx, vy = n * sab - sa * sb, n * saa - sa * sa, n * sbb - sb * sb
    return F.when((n >= 3) & (vx > 0) & (vy > 0), round_dp(cov / (F.sqrt(vx) * F.sqrt(vy)), places))


def best_per_key(rows: DataFrame, keys: list[str], order: list, limit: int, out: str = "place") -> DataFrame:
    """First ``limit`` rows per key. Catalyst trims each task to ``limit`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(window)).where(F.col(out) <= limit)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep-first by an explicit order, as a hash aggregate."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")
