"""Structure lines and polygon borders near cells: distances, trends, crossings, districts."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid import fixed
from lodegrid.functions import geo
from lodegrid.functions import grid as g
from lodegrid.functions.scalars import favourable_trend, holds, never_null, round_dp, to_fixed
from lodegrid.operators import spatial
from lodegrid.operators.ranking import best_per_key
from lodegrid.session import dealt, materialise, shuffled


def line_segments(lines: DataFrame, keys: list[str], parts: str = "parts") -> DataFrame:
    """Segments of ``parts`` (array of vertex arrays of struct(x, y) in degrees); a point is one empty segment."""
    part = lines.select(*keys, F.posexplode(parts).alias("part", "_v"))
    last = F.size("_v")
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), last - 1))
    at = lambda i: F.element_at("_v", F.least(i, last))
    seg = F.transform(steps, lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b")))
    out = part.select(*keys, "part", F.posexplode_outer(seg).alias("seq", "_s"))
    return out.select(
        *keys, "part", "seq", *[never_null(F.col(f"_s.{e}.{c}")).alias(f"{e}{c}") for e in ("a", "b") for c in ("x", "y")])


def with_metres(segments: DataFrame) -> DataFrame:
    xa, ya = g.to_grid_metres(F.col("ax"), F.col("ay"))
    xb, yb = g.to_grid_metres(F.col("bx"), F.col("by"))
    return segments.withColumns({"xa": xa, "ya": ya, "xb": xb, "yb": yb})


def trend_and_length(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Azimuth of the longest part's chord and total length in metres; closed traces and points have no trend."""
    m = with_metres(segments)
    length = F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))
    parts = m.groupBy(*keys, "part").agg(
        (F.sum(to_fixed(length, 3)).cast("double") / 1e3).alias("_len"),
        F.min_by(F.struct("xa", "ya"), "seq").alias("_from"), F.max_by(F.struct("xb", "yb"), "seq").alias("_to"))
    chord = F.struct(
        (F.col("_to.xb") - F.col("_from.xa")).alias("dx"), (F.col("_to.yb") - F.col("_from.ya")).alias("dy"))
    whole = parts.groupBy(*keys).agg(
        F.max_by(chord, F.struct("_len", -F.col("part"))).alias("_c"), F.sum("_len").alias("length_m"))
    return whole.select(*keys, geo.azimuth(F.col("_c.dx"), F.col("_c.dy")).alias("azimuth_deg"), "length_m")


def _to_buckets(segments: DataFrame, reach: float, size: float) -> DataFrame:
    """List each segment in every bucket its bounds touch when widened by ``reach``."""
    span = lambda a, b: F.sequence(
        F.floor((F.least(a, b) - reach) / size).cast("int"), F.floor((F.greatest(a, b) + reach) / size).cast("int"))
    m = with_metres(segments).withColumns({
        "_x0": F.least("xa", "xb"), "_x1": F.greatest("xa", "xb"), "_y0": F.least("ya", "yb"), "_y1": F.greatest("ya", "yb")})
    out = m.withColumn("_bx", F.explode_outer(span(F.col("xa"), F.col("xb"))))
    return out.withColumn("_by", F.explode_outer(span(F.col("ya"), F.col("yb")))).drop("xa", "ya", "xb", "yb")


def cells_near_segments(framed: DataFrame, segments: DataFrame, radius_m: float, max_res: int,
                        cell_keys: list[str], line_keys: list[str], side: float = 0.75) -> DataFrame:
    """Least distance between a cell's square and each line within ``radius_m``; 0 when they meet.

    ``side`` is that of a bucket in terms of the reach: the fewer cells there are, the wider buckets may be.
    """
    reach = (radius_m + spatial.HALF_DIAGONAL * max_res) * spatial.SLACK
    size = side * reach
    placed = framed.withColumns({
        "_tx": g.centre_x(F.col("col"), F.col("res")), "_ty": g.centre_y(F.col("row"), F.col("res")),
        "_bx": F.floor(g.centre_x(F.col("col"), F.col("res")) / size).cast("int"),
        "_by": F.floor(g.centre_y(F.col("row"), F.col("res")) / size).cast("int")})
    pairs = spatial.split_join(_to_buckets(segments, reach, size), placed, ["_bx", "_by"])
    # Centre against bounds in the plane first: most listed pairs end here.
    ahead = (F.col("_tx") >= F.col("_x0") - reach) & (F.col("_tx") <= F.col("_x1") + reach)
    ahead = ahead & (F.col("_ty") >= F.col("_y0") - reach) & (F.col("_ty") <= F.col("_y1") + reach)
    pairs = pairs.where(holds(ahead)).drop("_tx", "_ty", "_x0", "_x1", "_y0", "_y1", "_bx", "_by")
    return _least_distance(pairs, radius_m, cell_keys, line_keys)


def _least_distance(pairs: DataFrame, radius_m: float, cell_keys: list[str], line_keys: list[str]) -> DataFrame:
    """Distance of each line to each cell from pairs of a framed cell and a segment, as far as ``radius_m``."""
    local = {}
    for end in ("a", "b"):
        x, y = geo.local_xy(F.col(f"{end}x"), F.col(f"{end}y"), F.col("lon0f"), F.col("lat0f"), F.col("mx"))
        local[f"l{end}x"], local[f"l{end}y"] = x, y
    pairs = pairs.withColumns(local)
    close = F.lit(True)
    for axis, corner in (("x", "px"), ("y", "py")):
        corners = [F.col(f"{corner}{i}") for i in range(4)]
        ends = [F.col(f"la{axis}"), F.col(f"lb{axis}")]
        close = close & (F.least(*ends) - F.greatest(*corners) <= radius_m) & (F.least(*corners) - F.greatest(*ends) <= radius_m)
    pairs = pairs.where(holds(close))
    a, b = (F.col("lax"), F.col("lay")), (F.col("lbx"), F.col("lby"))
    inside = F.lit(True)
    for i in range(4):
        inside = inside & (F.col(f"sx{i}") * (a[1] - F.col(f"py{i}")) - F.col(f"sy{i}") * (a[0] - F.col(f"px{i}")) >= 0)
    side = F.explode(F.array(*[F.struct(
        F.col(f"px{i}").alias("x0"), F.col(f"py{i}").alias("y0"),
        F.col(f"px{(i + 1) % 4}").alias("x1"), F.col(f"py{(i + 1) % 4}").alias("y1")) for i in range(4)])).alias("_s")
    sides = pairs.select(*cell_keys, *line_keys, "lax", "lay", "lbx", "lby", inside.alias("_in"), side)
    c, e = (F.col("_s.x0"), F.col("_s.y0")), (F.col("_s.x1"), F.col("_s.y1"))
    # Turns and feet of perpendiculars become columns, so that the distance is written out once.
    steps = {"_o1": geo.cross(*a, *b, *c), "_o2": geo.cross(*a, *b, *e), "_o3": geo.cross(*c, *e, *a), "_o4": geo.cross(*c, *e, *b)}
    feet = {"_f1": (a, c, e), "_f2": (b, c, e), "_f3": (c, a, b), "_f4": (e, a, b)}
    steps.update({k: geo.foot(*p, *q, *r) for k, (p, q, r) in feet.items()})
    placed_sides = sides.withColumns(steps)
    apart = F.least(*[geo.offset(*p, *q, *r, F.col(k)) for k, (p, q, r) in feet.items()])
    crossing = (F.col("_o1") * F.col("_o2") < 0) & (F.col("_o3") * F.col("_o4") < 0)
    d = F.when(F.col("_in") | crossing, F.lit(0.0)).otherwise(apart)
    found = placed_sides.groupBy(*cell_keys, *line_keys).agg(F.min(d).alias("_d"))
    # A shared end point may miss zero by rounding.
    distance = F.when(F.col("_d") < 1e-6, F.lit(0.0)).otherwise(F.col("_d"))
    found = found.select(*cell_keys, *line_keys, distance.alias("distance_m"))
    return found.where(F.col("distance_m") <= radius_m)


def with_nearest_beyond(framed: DataFrame, segments: DataFrame, near: DataFrame, radius_m: float, max_res: int,
                        cell_keys: list[str], line_keys: list[str], widest_m: float = 2_000_000.0) -> DataFrame:
    """``near`` (all lines within ``radius_m``) and, for cells with none, their nearest line at any distance.

    The search widens fourfold for cells that are still without one; whatever is found first is nearest, as each
    round sees every line within its radius. ``widest_m`` exceeds the extent of the grid's envelope.
    """
    found = near
    todo = materialise(framed.join(shuffled(near.select(*cell_keys).distinct()), cell_keys, "left_anti"), "without-line")
    while radius_m < widest_m and not todo.isEmpty():
        radius_m *= 4
        reached = cells_near_segments(todo, segments, radius_m, max_res, cell_keys, line_keys)
        best = reached.groupBy(*cell_keys).agg(F.min_by(F.struct(*line_keys, "distance_m"), F.struct("distance_m", line_keys[0])).alias("_b"))
        best = materialise(best.select(*cell_keys, "_b.*"), "nearest-line")
        found = found.unionByName(best.select(*found.columns))
        todo = todo.join(shuffled(best.select(*cell_keys)), cell_keys, "left_anti")
    return found


# --- cells that many areas share (see ``spatial``) ----------------------------------------------
def lines_near_squares(framed: DataFrame, segments: DataFrame, line_key: str, buffer_m: float, max_res: int,
                       kinds: str | None = None, beyond: bool = True, widest_m: float = 2_000_000.0) -> DataFrame:
    """Lines near cells of the grid with bounds of their distance (low_m, high_m) over the frames of all areas, stored.

    Listed are those that may be within ``buffer_m`` and, with ``beyond``, those that may be the nearest at any distance (of
    their kind, where ``kinds`` names a column of the segments). The search widens fourfold for cells without a line that is surely in its radius.
    """
    todo, found, radius = spatial.squares(framed), None, buffer_m * 1.02
    by = [line_key] + ([kinds] if kinds else [])
    while True:
        reached = cells_near_segments(todo, segments, radius, max_res, [*spatial.SQUARE, "stretch"], by, side=2.0)
        reached = materialise(reached.withColumns(spatial.bounds()).drop("stretch"), "reached")
        least = reached.groupBy(*spatial.SQUARE).agg(F.min("high_m").alias("_least"))
        last = not beyond or radius >= widest_m
        done = reached.join(shuffled(least), spatial.SQUARE).where((F.col("low_m") <= buffer_m) | (F.col("low_m") <= F.col("_least")))
        done = (done if last else done.where(F.col("_least") <= radius)).drop("_least")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        todo = materialise(todo.join(shuffled(least.where(F.col("_least") <= radius)), spatial.SQUARE, "left_anti"), "without-line")
        if todo.isEmpty():
            return found
        radius *= 4


def measured_lines(framed: DataFrame, near: DataFrame, segments: DataFrame, line_key: str, keys: list[str]) -> DataFrame:
    """Lines of cells of the grid for each area that has the cell, with their distance in its frame."""
    drawn = near.select(*spatial.SQUARE, line_key).join(shuffled(segments.select(line_key, "ax", "ay", "bx", "by")), line_key)
    return _least_distance(spatial.split_join(framed, drawn, spatial.SQUARE), float("inf"), keys, [line_key])


def shared_structure_facts(framed: DataFrame, near: DataFrame, segments: DataFrame, lines: DataFrame, keys: list[str], crossings: DataFrame | None = None,
                           buffer_m: float = fixed.STRUCTURE_BUFFER_M, most_azimuths: int = 8, most_favourable: int = 6, most_names: int = 4) -> DataFrame:
    """``structure_facts`` of areas' cells from ``lines_near_squares``: lines whose place is the same in every frame are counted
    once per cell of the grid, only the others are measured for each area. ``lines`` has line_id, kind, name, azimuth_deg."""
    square, low, high = spatial.SQUARE, F.col("low_m"), F.col("high_m")
    tenth = round_dp(F.pmod(F.col("azimuth_deg"), F.lit(180.0)), 1)
    near = near.join(shuffled(lines.select("line_id", "kind", "name", tenth.alias("azimuth"))), "line_id")
    least = near.groupBy(*square, "kind").agg(F.min("high_m").alias("_kind"))
    over = least.groupBy(*square).agg(F.min("_kind").alias("_any"))
    near = materialise(near.join(shuffled(least), [*square, "kind"]).join(shuffled(over), square), "near")
    sure, open_ = high <= buffer_m, (low <= buffer_m) & (high > buffer_m)

    def told(rows: DataFrame, by: list[str], inside: Column, at: Column, prefix: str) -> DataFrame:
        """Counts, least distances, azimuths and names; ``at`` is the distance where it is known."""
        per_kind = []
        for k in fixed.STRUCTURE_KINDS:
            mine = F.col("kind") == k
            per_kind += [F.count_if(mine & inside).alias(f"{prefix}n_{k}"), F.min(F.when(mine & (at <= buffer_m), at)).alias(f"{prefix}d_{k}")]
        # Azimuths are kept to tenths of a degree: 1800 values at most.
        listed = lambda c, n, name: F.slice(F.sort_array(F.collect_set(F.when(inside & c, F.col("azimuth")))), 1, n + 1).alias(prefix + name)
        main = rows.groupBy(*by).agg(
            *per_kind, listed(F.lit(True), most_azimuths, "az"), listed(favourable_trend(F.col("azimuth")), most_favourable, "fav"),
            F.min_by(F.struct("kind", at.alias("distance_m")), F.when(at.isNotNull(), F.struct(at.alias("d"), "line_id"))).alias(f"{prefix}near"))
        named = rows.where(inside & F.col("name").isNotNull()).groupBy(*by, "name").agg(F.min("line_id").alias("_id"))
        named = best_per_key(named, by, [F.asc("_id"), F.asc("name")], most_names + 1).groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct("_id", "name"))).alias(f"{prefix}names"))
        return main.join(shuffled(named), by, "left")

    once_ = told(near, square, sure, F.when(high == 0, 0.0), "s_")
    unsure = near.where(open_ | ((high > 0) & ((low <= F.col("_kind")) | (low <= F.col("_any")))))
    attributes = unsure.select(*square, "line_id", "kind", "name", "azimuth", open_.alias("_open"))
    exact = measured_lines(framed, unsure, segments, "line_id", [*keys, "res"]).join(shuffled(attributes), [*square, "line_id"])
    here = told(materialise(exact, "measured"), keys, F.col("_open") & (F.col("distance_m") <= buffer_m), F.col("distance_m"), "o_")
    out = framed.select(*dict.fromkeys([*keys, *square])).join(shuffled(once_), square, "left").join(shuffled(here), keys, "left")
    none = F.array().cast("array<double>")
    both = lambda c, n: F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce(f"s_{c}", none), F.coalesce(f"o_{c}", none)))), 1, n + 1)
    pairs = F.array().cast(f"array<struct<_id:{near.schema['line_id'].dataType.simpleString()},name:string>>")
    names = F.array_sort(F.concat(F.coalesce("s_names", pairs), F.coalesce("o_names", pairs)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    cols = {}
    for k in fixed.STRUCTURE_KINDS:
        cols |= {f"_n_{k}": zero(f"s_n_{k}") + zero(f"o_n_{k}"), f"_d_{k}": F.coalesce(f"s_d_{k}", f"o_d_{k}")}
    out = out.withColumns(cols | {"_az": both("az", most_azimuths), "_fav": both("fav", most_favourable), "_all": names, "_n": F.coalesce("s_near", "o_near")})
    count = sum((F.col(f"_n_{k}") for k in fixed.STRUCTURE_KINDS), F.lit(0))
    # Of two lines with one name the lower id speaks.
    first = F.filter("_all", lambda s, i: ~F.exists(F.slice("_all", F.lit(1), i), lambda t: t["name"] == s["name"]))
    n = F.col("count")
    known = F.size("_az") > 0
    out = out.withColumns({"count": count, "_first": first})
    if crossings is not None:
        out = out.join(shuffled(crossings), square, "left")
    return out.select(
        *keys, "count", F.when(n > 0, _kinds()).alias("kinds"), F.when(known, F.slice("_az", 1, most_azimuths)).alias("azimuths"),
        F.when(known, F.slice("_fav", 1, most_favourable)).alias("favourable_azimuths"),
        F.when(n > 0, F.size("_fav") > 0).alias("favourable_trend"),
        F.when(F.size("_first") > 0, F.transform(F.slice("_first", 1, most_names), lambda s: s["name"])).alias("named"),
        ((F.size("_az") > most_azimuths) | (F.size("_fav") > most_favourable) | (F.size("_first") > most_names)).alias("truncated"),
        round_dp(F.col("_n.distance_m") / 1000.0, 2).alias("nearest_km"), F.col("_n.kind").alias("nearest_kind"),
        *(["fault_intersections_in_cell"] if crossings is not None else []))


def _kinds() -> Column:
    """Kinds that are in the buffer with their number (_n_) and least distance (_d_)."""
    return F.array_compact(F.array(*[F.when(F.col(f"_n_{k}") > 0, F.struct(
        F.lit(k).alias("kind"), F.col(f"_n_{k}").alias("n"), round_dp(F.col(f"_d_{k}") / 1000.0, 2).alias("km")))
        for k in sorted(fixed.STRUCTURE_KINDS)]))


def structure_facts(cells: DataFrame, near: DataFrame, keys: list[str], crossings: DataFrame | None = None,
                    buffer_m: float = fixed.STRUCTURE_BUFFER_M, most_azimuths: int = 8, most_favourable: int = 6, most_names: int = 4) -> DataFrame:
    """Counts, distances and trends of lines (line_id, kind, name, azimuth_deg) within the buffer of each cell.

    Lists are cut to the first ``most_azimuths``, ``most_favourable`` and ``most_names``, ``truncated`` tells where one was; ``near``
    itself has every line.
    With nothing in the buffer the count is 0 and the nearest line of any kind in the searched range is named.
    """
    near = materialise(near, "near")
    in_buffer = F.col("distance_m") <= buffer_m
    tenth = round_dp(F.pmod(F.col("azimuth_deg"), F.lit(180.0)), 1)
    per_kind = []
    for kind in fixed.STRUCTURE_KINDS:
        mine = in_buffer & (F.col("kind") == kind)
        per_kind += [F.count_if(mine).alias(f"_n_{kind}"), F.min(F.when(mine, F.col("distance_m"))).alias(f"_d_{kind}")]
    # Azimuths are kept to tenths of a degree: 1800 values at most.
    main = near.groupBy(*keys).agg(
        *per_kind, F.count_if(in_buffer).alias("count"),
        F.sort_array(F.collect_set(F.when(in_buffer, tenth))).alias("azimuths"),
        F.sort_array(F.collect_set(F.when(in_buffer & favourable_trend(tenth), tenth))).alias("favourable_azimuths"),
        F.count_if(in_buffer & F.col("azimuth_deg").isNotNull()).alias("_az"),
        F.min_by(F.struct("kind", "distance_m"), F.struct("distance_m", "line_id")).alias("_n"))
    main = main.withColumns({
        "kinds": F.when(F.col("count") > 0, _kinds()), "azimuths": F.when(F.col("_az") > 0, F.col("azimuths")),
        "favourable_azimuths": F.when(F.col("_az") > 0, F.col("favourable_azimuths"))})
    long = (F.size("azimuths") > most_azimuths) | (F.size("favourable_azimuths") > most_favourable)
    main = main.withColumn("_long", F.coalesce(long, F.lit(False))).withColumns({
        "azimuths": F.slice("azimuths", 1, most_azimuths), "favourable_azimuths": F.slice("favourable_azimuths", 1, most_favourable)})
    named = near.where(in_buffer & F.col("name").isNotNull()).groupBy(*keys, "name").agg(F.min("line_id").alias("_id"))
    named = best_per_key(named, keys, [F.asc("_id"), F.asc("name")], most_names + 1).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_names"))
    out = cells.select(*keys).join(shuffled(main), keys, "left").join(shuffled(named), keys, "left")
    if crossings is not None:
        out = out.join(shuffled(crossings), keys, "left")
    n = F.coalesce(F.col("count"), F.lit(0))
    return out.select(
        *keys, n.alias("count"), "kinds", "azimuths", "favourable_azimuths",
        F.when(n > 0, F.coalesce(F.size("favourable_azimuths") > 0, F.lit(False))).alias("favourable_trend"),
        F.transform(F.slice("_names", 1, most_names), lambda s: s["name"]).alias("named"),
        (F.coalesce("_long", F.lit(False)) | (F.coalesce(F.size("_names"), F.lit(0)) > most_names)).alias("truncated"),
        round_dp(F.col("_n.distance_m") / 1000.0, 2).alias("nearest_km"), F.col("_n.kind").alias("nearest_kind"),
        *(["fault_intersections_in_cell"] if crossings is not None else []))


# --- crossings of all faults --------------------------------------------------------------------
#: Side of a square in degrees; a square with more than MOST segments is quartered both ways, DEEPEST times at most.
#: Comparing bounds is far cheaper than listing a segment in the squares of a finer level, so only squares that are crowded beyond that are cut.
CROSSING_SQUARE, MOST, DEEPEST = 0.02, 1024, 4
#: Degrees. Points are dealt to squares by rounded coordinates, so segments are listed a little beyond the border.
_EDGE = 1e-6


def squares_passed(segments: DataFrame, side: float, within: float | None = None) -> DataFrame:
    """Each segment in the squares (_bx, _by) of the plane of degrees that it passes, column by column, borders on both sides.

    With ``within``, only squares inside the square of that side in which the row stands are listed.
    """
    column = lambda v, beyond: F.floor((v + beyond) / side).cast("bigint")
    lo_x, hi_x = F.least("ax", "bx"), F.greatest("ax", "bx")
    k = None if within is None else round(within / side)
    first, last = column(lo_x, -_EDGE), column(hi_x, _EDGE)
    if k:
        first, last = F.greatest(first, F.col("_bx") * k), F.least(last, F.col("_bx") * k + k - 1)
    out = segments.where(first <= last).withColumn("_c", F.explode(F.sequence(first, last)))
    slope = F.when(F.col("ax") != F.col("bx"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    y = lambda x: F.when(slope.isNull(), None).otherwise(F.col("ay") + (x - F.col("ax")) * slope)
    from_x, to_x = F.greatest(lo_x, F.col("_c") * side - _EDGE), F.least(hi_x, (F.col("_c") + 1) * side + _EDGE)
    y0, y1 = F.coalesce(y(from_x), F.col("ay")), F.coalesce(y(to_x), F.col("by"))
    low, high = column(F.least(y0, y1), -_EDGE), column(F.greatest(y0, y1), _EDGE)
    if k:
        low, high = F.greatest(low, F.col("_by") * k), F.least(high, F.col("_by") * k + k - 1)
    out = out.withColumns({"_l": low, "_h": high}).where("_l <= _h").withColumn("_r", F.explode(F.sequence("_l", "_h")))
    return out.drop("_bx", "_by", "_l", "_h").withColumnsRenamed({"_c": "_bx", "_r": "_by"})


def _met(listed: DataFrame, side: float, places: int | None) -> DataFrame:
    """Points shared by segments of two lines, each found in the square that holds it; with ``places`` rounded and distinct."""
    ends, square = ["ax", "ay", "bx", "by"], ["_bx", "_by"]
    kind = listed.schema["line_id"].dataType
    schema = T.StructType([T.StructField("line_id", kind), T.StructField("other_id", kind), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def find(batches):
        for rows, starts in _groups(batches, square):
            line = rows.column("line_id").chunk(0)
            new = np.r_[True, pc.not_equal(line[1:], line[:-1]).to_numpy(zero_copy_only=False)]
            new[starts[:-1]] = True
            codes, drawn = np.cumsum(new), np.array([rows.column(c).to_numpy() for c in ends], float)
            bx, by = (rows.column(c).to_numpy() for c in square)
            found, n = [], 0
            for a, b in zip(starts, starts[1:]):
                for i, j, x, y in _meeting_points(codes[a:b], drawn[:, a:b], (bx[a], by[a]), side, places) if b - a > 1 else ():
                    found.append((a + i, a + j, x, y))
                    n += len(i)
                if found and (n > 1 << 14 or b == starts[-1]):
                    i, j, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([line.take(pa.array(i)), line.take(pa.array(j)), pa.array(x), pa.array(y)], names=schema.names)
                    found, n = [], 0

    return dealt(listed, square).sortWithinPartitions(*square, "line_id").mapInArrow(find, schema)


def _groups(batches, keys: list[str]):
    """Rows sorted by ``keys`` with the starts of their groups, and the end; the last group of a batch is held until the next."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        new = np.zeros(len(rows), bool)
        for k in keys:
            c = rows.column(k).chunk(0)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(new).tolist()]
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]).combine_chunks(), starts
        held = rows.slice(starts[-1])
    if held is not None and len(held):
        yield held.combine_chunks(), [0, len(held)]


def _meeting_points(lines: np.ndarray, ends: np.ndarray, square: tuple[int, int], side: float, places: int | None):
    """Segments (of sorted lines) that meet inside the square, and where: (rows, columns, x, y) for some lines at a time."""
    high, wide = TILE
    starts = np.r_[np.flatnonzero(np.r_[True, lines[1:] != lines[:-1]]), len(lines)]
    first = 0
    while first < len(lines):
        last = starts[min(np.searchsorted(starts, first + high), len(starts) - 1)]
        found = []
        for r in range(first, last, high):
            for c in range(r, len(lines), wide):
                cols = ends[:, c:c + wide]
                i, j = np.divmod(np.flatnonzero(_touching(ends[:, r:min(r + high, last)], cols)), cols.shape[1])
                i, j = i + r, j + c
                two = lines[i] < lines[j]
                i, j = i[two], j[two]
                if not len(i):
                    continue
                x, y = _meeting_point(ends[:, i], ends[:, j])
                if places is not None:
                    scale = float(10**places)
                    x, y = np.floor(x * scale + 0.5) / scale, np.floor(y * scale + 0.5) / scale
                own = (np.floor(x / side) == square[0]) & (np.floor(y / side) == square[1])
                found.append((i[own], j[own], x[own], y[own]))
        first = last
        if not found:
            continue
        i, j, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
        if places is not None and len(i):
            order = np.lexsort((y, x, lines[j], lines[i]))
            i, j, x, y = i[order], j[order], x[order], y[order]
            new = np.ones(len(i), bool)
            new[1:] = (lines[i][1:] != lines[i][:-1]) | (lines[j][1:] != lines[j][:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            i, j, x, y = i[new], j[new], x[new], y[new]
        if len(i):
            yield i, j, x, y


def _meeting_point(p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments that touch meet, one by one, as ``geo.meeting_point`` tells."""
    turn = lambda q, x, y: (q[2] - q[0]) * (y - q[1]) - (q[3] - q[1]) * (x - q[0])
    ends = [(p, s[:2]), (p, s[2:]), (s, p[:2]), (s, p[2:])]
    turns = [turn(q, *e) for q, e in ends]
    x, y = np.full((2, p.shape[1]), np.inf)
    for t, (q, (ex, ey)) in zip(turns, ends, strict=True):
        on = (t == 0) & (ex >= np.minimum(q[0], q[2])) & (ex <= np.maximum(q[0], q[2])) & (ey >= np.minimum(q[1], q[3])) & (ey <= np.maximum(q[1], q[3]))
        on &= (ex < x) | ((ex == x) & (ey < y))
        x, y = np.where(on, ex, x), np.where(on, ey, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = turns[2] / (turns[2] - turns[3])
        return np.where(x == np.inf, p[0] + t * (p[2] - p[0]), x), np.where(x == np.inf, p[1] + t * (p[3] - p[1]), y)


def crossing_points(segments: DataFrame, side: float = CROSSING_SQUARE, most: int = MOST, deepest: int = DEEPEST, places: int | None = None) -> DataFrame:
    """line_id, other_id, x, y (degrees): every point in which two lines cross or touch, with ``places`` rounded (to six at most) and distinct.

    A segment meets only those that pass a square with it, and a point belongs to one square, so no line is compared with
    a line and no point is found twice. Crowded squares are cut into sixteen by their counts.
    """
    todo = squares_passed(segments.select("line_id", "ax", "ay", "bx", "by"), side)
    found = None
    for level in range(deepest + 1):
        todo = materialise(todo, "squares")
        crowded = todo.groupBy("_bx", "_by").agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n")
        deep = level < deepest and not crowded.isEmpty()
        here = _met(todo.join(shuffled(crowded), ["_bx", "_by"], "left_anti") if deep else todo, side, places)
        found = here if found is None else found.unionByName(here)
        if not deep:
            return found
        todo = squares_passed(todo.join(shuffled(crowded), ["_bx", "_by"], "left_semi"), side / 4, within=side)
        side /= 4


#: Segments of a cell that are held at once; rows and columns of the pairs of segments that are tested at once.
HELD, TILE = 4096, (128, 512)


def _touching(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which segments of ``p`` (ax, ay, bx, by; rows) share a point with which of ``s`` (columns), as ``geo.segments_touch`` tells."""
    u, v, w = np.empty((3, p.shape[1], s.shape[1]))

    def turn(q, x, y, out):
        np.multiply(np.subtract(y, q[1], out=out), q[2] - q[0], out=out)
        np.multiply(np.subtract(x, q[0], out=w), q[3] - q[1], out=w)
        return np.subtract(out, w, out=out)

    rows, cols = p[:, :, None], s[:, None, :]
    left = np.multiply(turn(rows, *cols[:2], u), turn(rows, *cols[2:], v), out=u)
    met, open_ = left < 0, left == 0
    right = np.multiply(turn(cols, *rows[:2], u), turn(cols, *rows[2:], v), out=u)
    met &= right < 0
    open_ |= right == 0
    if open_.any():
        i, j = np.nonzero(open_)
        met[i, j] = _touching_ends(p[:, i], s[:, j])
    return met


def _touching_ends(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The same for pairs in line with an end of one another, one by one."""
    turn = lambda q, x, y: (q[2] - q[0]) * (y - q[1]) - (q[3] - q[1]) * (x - q[0])
    on = lambda q, x, y: (x >= np.minimum(q[0], q[2])) & (x <= np.maximum(q[0], q[2])) & (y >= np.minimum(q[1], q[3])) & (y <= np.maximum(q[1], q[3]))
    ends = [(p, s[:2]), (p, s[2:]), (s, p[:2]), (s, p[2:])]
    turns = [turn(q, *e) for q, e in ends]
    sign = [np.sign(t) for t in turns]
    met = (sign[0] * sign[1] < 0) & (sign[2] * sign[3] < 0)
    for t, (q, e) in zip(turns, ends, strict=True):
        met |= (t == 0) & on(q, *e)
    return met


def _count_touching(lines: np.ndarray, ends: np.ndarray, second: np.ndarray | None = None) -> int:
    """Pairs of lines that share a point; with ``second`` (true for segments of the other block) pairs of one line of either block.

    Segments are tested in tiles of bounded size; what is kept is one bit per pair of lines.
    """
    order = np.argsort(lines, kind="stable")
    sides = [order] * 2 if second is None else [order[~second[order]], order[second[order]]]
    if not all(map(len, sides)):
        return 0
    codes = [np.unique(lines[o], return_inverse=True)[1] for o in sides]
    (p, s), (left, right) = [ends[:, o] for o in sides], codes
    met = np.zeros((left[-1] + 1, right[-1] + 1), bool)
    high, wide = TILE
    for r in range(0, len(left), high):
        rows = left[r:r + high]
        # A pair of one block has its later line to the right, so columns before the row are left out.
        for c in range(0 if second is not None else r, len(right), wide):
            cols = right[c:c + wide]
            i, j = np.divmod(np.flatnonzero(_touching(p[:, r:r + high], s[:, c:c + wide])), len(cols))
            met[rows[i], cols[j]] = True
    return int(np.count_nonzero(met if second is not None else np.triu(met, 1)))


def fault_crossings_all(near: DataFrame, segments: DataFrame, keys: list[str], held: int = HELD) -> DataFrame:
    """Pairs of faults that both meet a cell and cross or touch each other, for any number of faults in the cell.

    Faults of a cell meet inside the cell, and a pair is counted where it is met: none is written or shuffled. A cell of more
    than ``held`` segments is dealt out in blocks of its faults, and every two blocks meet on their own.
    """
    ends = ["ax", "ay", "bx", "by"]
    inside = near.where((F.col("kind") == "fault") & (F.col("distance_m") == 0)).select(*keys, "line_id").distinct()
    drawn = materialise(inside.join(shuffled(segments.select("line_id", *ends)), "line_id"), "faults")
    crowded = drawn.groupBy(*keys).agg(F.ceil(F.count("*") / held).cast("int").alias("_of"))
    block = F.pmod(F.xxhash64("line_id"), F.col("_of")).cast("int")
    rows = drawn.join(shuffled(crowded), keys).withColumn("_own", block).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    rows = rows.select(*keys, F.least("_own", "_with").alias("_i"), F.greatest("_own", "_with").alias("_j"), "_own", F.xxhash64("line_id").alias("_line"), *ends)
    groups = [*keys, "_i", "_j"]

    schema = T.StructType([*[near.schema[k] for k in keys], T.StructField("n", T.LongType())])

    def told(rows: pa.Table, starts: list[int]) -> pa.RecordBatch:
        i, j, own, line = (rows.column(c).to_numpy() for c in ("_i", "_j", "_own", "_line"))
        drawn = np.array([rows.column(c).to_numpy() for c in ends], float)
        n = [_count_touching(line[a:b], drawn[:, a:b], None if i[a] == j[a] else own[a:b] == j[a]) for a, b in zip(starts, starts[1:])]
        known = rows.select(keys).take(starts[:-1]).combine_chunks()
        return pa.RecordBatch.from_arrays([*[known.column(k).chunk(0) for k in keys], pa.array(n, pa.int64())], names=schema.names)

    def count(batches):
        for rows, starts in _groups(batches, groups):
            yield told(rows, starts)

    counted = dealt(rows, groups).sortWithinPartitions(*groups).mapInArrow(count, schema)
    return counted.groupBy(*keys).agg(F.sum("n").alias("fault_intersections_in_cell")).where("fault_intersections_in_cell > 0")


def trend_by_cell(mapped: DataFrame, structures: DataFrame, keys: list[str]) -> DataFrame:
    """Favourable trend nearby: true or false only where the cell is mapped, else null."""
    return structures.join(shuffled(mapped.select(*keys, F.lit(True).alias("_m")).distinct()), keys, "left").select(
        *keys, F.when(F.col("_m"), F.coalesce("favourable_trend", F.lit(False))).alias("favourable_trend"))


def polygon_of_cell(cells: DataFrame, covered: DataFrame, borders: DataFrame, keys: list[str], poly: str) -> DataFrame:
    """Polygon a cell meets (0 km), else the nearest border in reach. The lower id settles ties.

    ``covered`` lists (keys, poly) of cells the polygon touches; ``borders`` lists distances to its border.
    """
    inside = covered.select(*keys, poly, F.lit(0.0).alias("distance_m"))
    both = inside.unionByName(borders.select(*keys, poly, "distance_m"))
    best = both.groupBy(*keys).agg(F.min(F.struct("distance_m", poly)).alias("_b"))
    out = cells.select(*keys).join(shuffled(best), keys, "left")
    return out.select(*keys, f"_b.{poly}", round_dp(F.col("_b.distance_m") / 1000.0, 2).alias("km"),
                      (F.col("_b.distance_m") == 0).alias("inside"))


def azimuth_histogram(lines: DataFrame) -> DataFrame:
    return lines.where("azimuth_deg is not null").groupBy(
        (F.floor(F.col("azimuth_deg") / 15.0) * 15).cast("int").alias("bin")).agg(
        F.count("*").alias("lines"), F.count_if(favourable_trend(F.col("azimuth_deg"))).alias("favourable"))


def longest_structures(lines: DataFrame, limit: int = 60) -> DataFrame:
    """Longest lines of an area: a bounding fault matters more than a splay, and the list is capped."""
    return lines.select(
        "line_id", "kind", "name", round_dp(F.col("azimuth_deg"), 1).alias("azimuth_deg"),
        round_dp(F.coalesce("length_m", F.lit(0.0)) / 1000.0, 2).alias("length_km"),
        favourable_trend(F.col("azimuth_deg")).alias("favourable_trend"),
    ).orderBy(F.desc("length_km"), "line_id").limit(limit)
