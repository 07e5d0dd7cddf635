"""Distance joins without cross joins: both sides meet in square buckets of the equal-area plane.

The bucket side exceeds the search radius, so a match lies in the same or a neighbouring bucket. Every bucket
is spread over a few tasks by salt; each distance is then checked exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions import geo
from lodegrid.functions import grid as g
from lodegrid.functions.scalars import exact_sum, holds, never_null, novelty, once, round_dp
from lodegrid.operators.ranking import best_per_key
from lodegrid.session import dealt, materialise, shuffled, spread_join

#: Local frames and the equal-area plane differ by under five percent inside the envelope.
SLACK = 1.05
#: Centre to corner of a square of side 1, rounded up.
HALF_DIAGONAL = 0.7072
#: Tasks over which each bucket is spread.
PARTS = 4


def split_join(many: DataFrame, few: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Inner equi-join whose keys are spread over ``parts`` tasks on both sides.

    Each row of ``many`` draws a salt; rows of ``few`` go to every salt. What is still large after that is
    split by the engine, as both sides come straight from their shuffles.
    """
    return spread_join(many, few, keys, salts=parts)


def _bucket(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def bucket_pairs(targets: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Pairs of targets (_tx, _ty) and points (_px, _py) whose buckets touch; ``size`` bounds the match."""
    t = targets.withColumns({"_bx": _bucket(F.col("_tx"), size), "_by": _bucket(F.col("_ty"), size)})
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND])
    p = points.withColumn("_o", F.explode(offsets)).select(
        *points.columns, (_bucket(F.col("_px"), size) + F.col("_o.i")).alias("_bx"),
        (_bucket(F.col("_py"), size) + F.col("_o.j")).alias("_by"))
    return split_join(p, t, ["_bx", "_by"]).drop("_bx", "_by")


# --- cells of an area in its own metre frame ----------------------------------------------------
def area_bbox(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of each area from its cells (with degree bounds)."""
    return cells.groupBy(*keys).agg(
        F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def framed_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cell corners in metres of a frame centred on the area (px0, py0 .. px3, py3), and the frame itself.

    Corners feed the frame and the cells, and framed cells feed several joins, so both are stored once.
    """
    full = materialise(g.with_bbox(g.with_corners(cells.select(*keys, "res", "col", "row"))), "corners")
    box = area_bbox(full, keys)
    frame = box.select(
        *keys, ((F.col("min_lon") + F.col("max_lon")) / 2.0).alias("lon0f"),
        ((F.col("min_lat") + F.col("max_lat")) / 2.0).alias("lat0f"))
    frame = frame.withColumn("mx", geo.metres_per_degree_lon(F.col("lat0f")))
    out = spread_join(full.drop("min_lon", "min_lat", "max_lon", "max_lat"), frame, keys)
    return materialise(_in_frame(out), "framed")


def _in_frame(out: DataFrame) -> DataFrame:
    """Corners, sides and their inverse squares in the frame (lon0f, lat0f, mx) that each row carries."""
    new = {}
    for i in range(4):
        x, y = geo.local_xy(F.col(f"lon{i}"), F.col(f"lat{i}"), F.col("lon0f"), F.col("lat0f"), F.col("mx"))
        new[f"px{i}"], new[f"py{i}"] = never_null(x), never_null(y)
    new.update({c: never_null(F.col(c)) for c in ("lon0f", "lat0f", "mx")})
    out = out.withColumns(new).drop(*[f"{a}{i}" for a in ("lon", "lat") for i in range(4)])
    sides = {}
    for i in range(4):
        sides[f"sx{i}"] = F.col(f"px{(i + 1) % 4}") - F.col(f"px{i}")
        sides[f"sy{i}"] = F.col(f"py{(i + 1) % 4}") - F.col(f"py{i}")
    out = out.withColumns(sides)
    return out.withColumns({f"sw{i}": never_null(
        1.0 / (F.col(f"sx{i}") * F.col(f"sx{i}") + F.col(f"sy{i}") * F.col(f"sy{i}"))) for i in range(4)})


_FRAME = ["lon0f", "lat0f", "mx"] + [f"{a}{i}" for a in ("px", "py", "sx", "sy", "sw") for i in range(4)]


def _square_distance(px: str, py: str) -> tuple[dict[str, Column], Column]:
    """Foot of the perpendicular on each side (as columns), and the distance to the square, 0 inside.

    Kept in two steps so that no expression is written out twice in the generated code.
    """
    feet, inside, spans = {}, None, []
    for i in range(4):
        dx, dy = F.col(px) - F.col(f"px{i}"), F.col(py) - F.col(f"py{i}")
        sx, sy = F.col(f"sx{i}"), F.col(f"sy{i}")
        feet[f"_t{i}"] = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dx * sx + dy * sy) * F.col(f"sw{i}")))
        left = sx * dy - sy * dx >= 0
        inside = left if inside is None else inside & left
        t = F.col(f"_t{i}")
        spans.append(F.hypot(dx - t * sx, dy - t * sy))
    return feet, F.when(inside, F.lit(0.0)).otherwise(F.least(*spans))


def cells_near_points(framed: DataFrame, points: DataFrame, radius_m: float, max_res: int) -> DataFrame:
    """(cell, point) pairs within ``radius_m`` of the cell's square, with ``distance_m`` (0 inside)."""
    reach = (radius_m + HALF_DIAGONAL * max_res) * SLACK
    targets = framed.withColumns({
        "_tx": g.centre_x(F.col("col"), F.col("res")), "_ty": g.centre_y(F.col("row"), F.col("res"))})
    px, py = g.to_grid_metres(F.col("lon"), F.col("lat"))
    located = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumns({"_px": px, "_py": py})
    pairs = bucket_pairs(targets, located, reach)
    near = (F.abs(F.col("_px") - F.col("_tx")) <= reach) & (F.abs(F.col("_py") - F.col("_ty")) <= reach)
    return _within(pairs.where(holds(near)).drop("_tx", "_ty", "_px", "_py"), radius_m)


def _within(pairs: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of a framed cell and a point (lon, lat) with their distance, as far as ``radius_m``."""
    lx, ly = geo.local_xy(F.col("lon"), F.col("lat"), F.col("lon0f"), F.col("lat0f"), F.col("mx"))
    feet, distance = _square_distance("_lx", "_ly")
    out = pairs.withColumns({"_lx": never_null(lx), "_ly": never_null(ly)}).withColumns(feet)
    kept = [c for c in out.columns if c not in _FRAME and not c.startswith("_")]
    out = out.select(*kept, once(distance).alias("distance_m"))
    return out.where(F.col("distance_m") <= radius_m)


# --- cells that many areas share ----------------------------------------------------------------
# Frames of areas differ in ``mx`` only, by a few parts in a thousand, so the distance in any of them lies between bounds
# that are found once per cell of the grid. What the bounds settle is not measured again for every area.
SQUARE = ["res", "col", "row"]


def squares(framed: DataFrame) -> DataFrame:
    """Each cell of the grid once, in the frame with the least ``mx`` of its areas, and how much the largest exceeds it (stretch)."""
    once_ = framed.groupBy(*SQUARE).agg(F.min("mx").alias("mx"), (F.max("mx") / F.min("mx")).alias("stretch"))
    boxed = g.with_bbox(g.with_corners(dealt(once_, SQUARE)))
    middle = {"lon0f": (F.col("min_lon") + F.col("max_lon")) / 2.0, "lat0f": (F.col("min_lat") + F.col("max_lat")) / 2.0}
    return materialise(_in_frame(boxed.withColumns(middle).drop("min_lon", "min_lat", "max_lon", "max_lat")), "squares")


def bounds(distance: str = "distance_m", stretch: str = "stretch") -> dict[str, Column]:
    """Least and greatest distance over all frames, with a margin for rounding; 0 is 0 in all of them."""
    d = F.col(distance)
    return {"low_m": F.when(d > 0, d * (1 - 1e-9) - 1e-6).otherwise(0.0), "high_m": F.when(d > 0, d * F.col(stretch) * (1 + 1e-9) + 1e-6).otherwise(0.0)}


def near_squares(framed: DataFrame, points: DataFrame, radius_m: float, max_res: int) -> DataFrame:
    """(cell of the grid, point) pairs that may be within ``radius_m`` for some area, with bounds of their distance, stored."""
    pairs = cells_near_points(squares(framed), points, radius_m, max_res)
    return materialise(pairs.withColumns(bounds()).drop("distance_m", "stretch"), "near")


def measured(framed: DataFrame, pairs: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of cells of the grid for each area that has the cell, with their distance in its frame, as far as ``radius_m``."""
    return _within(split_join(framed, pairs.drop("low_m", "high_m"), SQUARE), radius_m)


def first_near(framed: DataFrame, pairs: DataFrame, radius_m: float, orders: list[tuple[list[Column], int]], tie: str = "site_id") -> DataFrame:
    """Pairs of areas' cells and points, measured, among them the first of every cell in each of ``orders``.

    An order is its leading columns, which do not depend on the area, and how many are wanted; distance and ``tie`` come
    last. Left out is what as many others precede in every frame.
    """
    kept, wanted = pairs, F.lit(False)
    sure = pairs.where(F.col("high_m") <= radius_m)
    for n, (lead, limit) in enumerate(orders):
        lead = [c.alias(f"l{i}") for i, c in enumerate(lead)]
        high, low, last = F.col("high_m"), F.col("low_m"), F.col(f"_last{n}")
        first = best_per_key(sure, SQUARE, [*lead, F.asc("high_m"), F.asc(tie)], limit, "_k")
        ends = first.groupBy(*SQUARE).agg(F.max(F.struct(*lead, high.alias("m"), F.col(tie).alias("t"))).alias(f"_last{n}"), F.count("*").alias(f"_n{n}"))
        kept = kept.join(shuffled(ends), SQUARE, "left")
        before = [last[f"l{i}"].alias(f"l{i}") for i in range(len(lead))]
        ahead = F.when(high == 0, F.struct(*lead, high.alias("m"), F.col(tie).alias("t")) <= last).otherwise(
            F.struct(*lead, low.alias("m")) <= F.struct(*before, last["m"].alias("m")))
        wanted = wanted | F.coalesce(F.col(f"_n{n}") < limit, F.lit(True)) | ahead
    return measured(framed, kept.where(wanted).select(*pairs.columns), radius_m)


def counts_near(framed: DataFrame, keys: list[str], pairs: DataFrame, radius_m: float) -> DataFrame:
    """Records by distance around every cell: counted per cell of the grid, and per area only at positions that its frame decides on."""
    low, high = F.col("low_m"), F.col("high_m")
    steps = {"n_in_cell": 0.0, "n_1km": 1000.0, "n_2km": 2000.0, "n_near": radius_m}
    flags = {"with_assays": "assays", "with_production": "production"}
    open_ = F.lit(False)
    for t in steps.values():
        open_ = open_ | ((low <= t) & (high > t))
    sure = pairs.where(~open_).groupBy(*SQUARE).agg(
        *[F.count_if(high <= t).alias(f"_{n}") for n, t in steps.items()], *[F.count_if((high <= radius_m) & F.col(c)).alias(f"_{n}") for n, c in flags.items()])
    spots = pairs.where(open_).groupBy(*SQUARE, "lon", "lat").agg(F.count("*").alias("all"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    d = F.col("distance_m")
    # Kilometres as everywhere else, so that a limit falls on the same side.
    near = measured(framed, spots, radius_m).groupBy(*keys).agg(
        *[F.sum(F.when(d / 1000.0 <= t / 1000.0, F.col("all"))).alias(n) for n, t in steps.items()], *[F.sum(n).alias(n) for n in flags])
    out = framed.select(*dict.fromkeys([*keys, *SQUARE])).join(shuffled(sure), SQUARE, "left").join(shuffled(near), keys, "left")
    return out.select(*keys, *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in (*steps, *flags)])


# --- occurrence facts ---------------------------------------------------------------------------
def accuracy_rank(x: Column) -> Column:
    pairs = [F.lit(v) for kv in fixed.ACCURACY_RANK.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(x, F.lit("unknown"))], F.lit(5))


def evidence_order() -> list[Column]:
    """Production, then assays, then trust in the position, then distance; the id settles ties."""
    return [
        F.when(F.col("production"), 0).otherwise(1), F.when(F.col("assays"), 0).otherwise(1),
        accuracy_rank(F.col("accuracy_class")), F.col("distance_m"), F.col("site_id"),
    ]


def occurrence_facts(cells: DataFrame, near: DataFrame, keys: list[str], any_points: bool | Column = True,
                     radius_km: float = fixed.SEARCH_RADIUS_KM, top: int = fixed.MAX_RECORDS_PER_CELL, counts: DataFrame | None = None) -> DataFrame:
    """Counts by distance, nearest and best-documented records of every cell.

    A layer without any record leaves every fact null (unknown); a populated layer with nothing in reach
    gives zeros and no nearest record. With ``counts`` (as ``counts_near`` gives them) ``near`` needs no more pairs than
    the first of each cell, and should be stored, as it is read twice.
    """
    near = materialise(near, "near") if counts is None else near
    km = F.col("distance_m") / 1000.0
    nearest = F.min_by(F.struct("site_id", "name", "accuracy_class", "distance_m"), F.struct("distance_m", "site_id")).alias("_near")
    if counts is None:
        counted = near.groupBy(*keys).agg(
            F.count_if(km <= 0).alias("n_in_cell"), F.count_if(km <= 1).alias("n_1km"),
            F.count_if(km <= 2).alias("n_2km"), F.count("*").alias("n_near"),
            F.count_if("assays").alias("with_assays"), F.count_if("production").alias("with_production"), nearest)
    else:
        counted = counts.join(shuffled(near.groupBy(*keys).agg(nearest)), keys, "left")
    ranked = best_per_key(near, keys, evidence_order(), top)
    records = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "place", "site_id", "name", "accuracy_class", "assays", "production",
        round_dp(km, 2).alias("km")))).alias("records"))
    out = cells.select(*keys).join(shuffled(counted), keys, "left").join(shuffled(records), keys, "left")
    known = any_points if isinstance(any_points, Column) else F.lit(any_points)
    zero = lambda c: F.when(known, F.coalesce(F.col(c), F.lit(0))).alias(c)
    best = F.try_element_at("records", F.lit(1))
    return out.select(
        *keys, *[zero(c) for c in ("n_in_cell", "n_1km", "n_2km", "n_near", "with_assays", "with_production")],
        round_dp(F.col("_near.distance_m") / 1000.0, 2).alias("nearest_km"), F.col("_near.name").alias("nearest_name"),
        F.col("_near.accuracy_class").alias("nearest_accuracy"), "records",
        F.when(best["site_id"] != F.col("_near.site_id"), best).alias("best"),
    )


def record_orders(top: int = fixed.MAX_RECORDS_PER_CELL, nearest: int = 3) -> list[tuple[list[Column], int]]:
    """Orders for ``first_near`` from which ``occurrence_facts`` and ``nearest_records`` can be told."""
    return [(evidence_order()[:3], top), ([], nearest)]


def nearest_records(near: DataFrame, keys: list[str], limit: int = 3, tie: str = "site_id") -> DataFrame:
    """The ``limit`` closest records of each cell, ascending."""
    rows = best_per_key(near, keys, [F.asc("distance_m"), F.asc(tie)], limit)
    return rows.withColumn("km", round_dp(F.col("distance_m") / 1000.0, 2))


def with_novelty(cells: DataFrame, facts: DataFrame, parent: str = "parent_cell_id") -> DataFrame:
    """Novelty by the cell's own facts, else by its parent's; unknown stays null."""
    cols = ["nearest_occurrence_km", "nearest_occurrence_name", "novelty"]
    known = facts.select("cell_id", *cols, F.lit(True).alias("_known"))
    own = known.select(F.col("cell_id"), *[F.col(c).alias(f"_o_{c}") for c in cols], F.col("_known").alias("_own"))
    up = known.select(F.col("cell_id").alias(parent), *[F.col(c).alias(f"_p_{c}") for c in cols])
    out = cells.join(shuffled(own), "cell_id", "left").join(shuffled(up), parent, "left")
    return out.withColumns({
        c: F.when(F.col("_own"), F.col(f"_o_{c}")).otherwise(F.col(f"_p_{c}")) for c in cols
    }).drop("_own", *[f"_{p}_{c}" for p in ("o", "p") for c in cols])


def novelty_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.select(
        *keys, F.col("nearest_km").alias("nearest_occurrence_km"), F.col("nearest_name").alias("nearest_occurrence_name"),
        # nothing in reach has no distance, so it stays unknown rather than becoming a lead
        novelty(F.col("nearest_km")).alias("novelty"))


# --- nearest neighbour at any distance ----------------------------------------------------------
def nearest_point(targets: DataFrame, points: DataFrame, key: str, name: str, start_m: float = 2_000.0,
                  max_m: float = 8_192_000.0) -> DataFrame:
    """For each target (key, lon, lat) its truly nearest point: nearest_km (unrounded), nearest_name.

    Equal positions on either side are collapsed first. The search starts in small buckets; a target is
    settled once its best distance is inside what the bucket size guarantees, and only the rest go on to
    buckets four times as wide, so dense ground is settled where candidates are few.
    """
    tx, ty = g.to_grid_metres(F.col("lon"), F.col("lat"))
    wanted = targets.select("lon", "lat").where("lon is not null and lat is not null").distinct()
    wanted = wanted.withColumns({"_tx": tx, "_ty": ty}).withColumnsRenamed({"lon": "_tlon", "lat": "_tlat"})
    unique = points.where("lon is not null and lat is not null").groupBy("lon", "lat").agg(F.min(name).alias("_name"))
    unique = materialise(unique.withColumns({"_px": tx, "_py": ty}), "points")
    found, size, todo = None, start_m, wanted
    while True:
        pairs = bucket_pairs(todo, unique, size)
        km = geo.km_between(F.col("_tlon"), F.col("_tlat"), F.col("lon"), F.col("lat"))
        best = pairs.withColumn("_km", km).groupBy("_tlon", "_tlat").agg(
            F.min(F.struct("_km", "_name")).alias("_b")).select("_tlon", "_tlat", "_b._km", "_b._name")
        step = materialise(todo.join(shuffled(best), ["_tlon", "_tlat"], "left"), "nearest")
        settled = F.col("_km") * 1000.0 * SLACK <= size
        last = size >= max_m
        done = step.where(F.col("_km").isNotNull() if last else settled).select("_tlon", "_tlat", "_km", "_name")
        found = done if found is None else found.unionByName(done)
        if last:
            break
        todo = step.where(~F.coalesce(settled, F.lit(False))).select("_tlon", "_tlat", "_tx", "_ty")
        if todo.isEmpty():
            break
        size *= 4
    answer = found.select(F.col("_tlon").alias("lon"), F.col("_tlat").alias("lat"),
                          F.col("_km").alias("nearest_km"), F.col("_name").alias("nearest_name"))
    return spread_join(targets, answer, ["lon", "lat"], "left", spread_on=[F.col(key)])


def nearest_within(sites: DataFrame, centres: DataFrame, centre_key: str, distance: Column, reach_x: Column,
                   reach_y: Column, size: float, accept: Column) -> DataFrame:
    """Nearest centre of each site among those whose own reach includes it.

    Each centre is listed in every bucket its reach touches, so a site meets it in one bucket only.
    Sites carry (site_key, sx, sy); centres carry (cx, cy) in the same units. Sites, and centres, that agree in all
    columns but the key are met once: of such centres the lowest key wins wherever they are nearest.
    """
    span = lambda c, r: F.sequence(F.floor((F.col(c) - r) / size).cast("int"), F.floor((F.col(c) + r) / size).cast("int"))
    at = [c for c in sites.columns if c != "site_key"]
    spots = sites.select(*at).distinct()
    unique = centres.groupBy(*[c for c in centres.columns if c != centre_key]).agg(F.min(centre_key).alias(centre_key))
    spread = unique.withColumn("_bx", F.explode(span("cx", reach_x))).withColumn("_by", F.explode(span("cy", reach_y)))
    placed = spots.withColumns({"_bx": _bucket(F.col("sx"), size), "_by": _bucket(F.col("sy"), size)})
    pairs = split_join(placed, spread, ["_bx", "_by"]).withColumn("_d", distance).where(holds(accept))
    best = F.min(F.struct(F.col("_d").alias("distance"), F.col(centre_key))).alias("_b")
    found = pairs.groupBy(*at).agg(best).select(*at, "_b.distance", f"_b.{centre_key}")
    return spread_join(sites, found, at).select("site_key", "distance", centre_key)


# --- interpolation to a finer grid --------------------------------------------------------------
def interpolate(fine: DataFrame, coarse: DataFrame, keys: list[str], fine_res: int, coarse_res: int,
                k: int = 4, values: tuple[str, ...] = ("score", "confidence")) -> DataFrame:
    """Inverse-square-distance mean over the k nearest coarse centres, and the containing coarse cell.

    A ring of r coarse cells around the parent holds every centre closer than (r + 1/2) coarse cells plus
    half a fine cell, so a fine cell is settled when its k-th neighbour lies inside that; only unsettled
    cells go on to a ring twice as wide. An area with no more than k coarse cells meets all of them at once. Ties go
    to the lower column, then the lower row.
    """
    ratio = coarse_res // fine_res
    cells = fine.select(*keys, "col", "row").withColumns({
        "_pc": F.floor(F.col("col") / ratio).cast("int"), "_pr": F.floor(F.col("row") / ratio).cast("int")})
    known = materialise(coarse.select(*keys, F.col("col").alias("_cc"), F.col("row").alias("_cr"), *values), "coarse")
    # Coarse and fine cells of an area span at most this many coarse cells; rings need not be wider.
    sides = known.select(*keys, "_cc", "_cr").unionByName(cells.select(*keys, F.col("_pc").alias("_cc"), F.col("_pr").alias("_cr")))
    spans = sides.groupBy(*keys).agg(F.greatest(F.max("_cc") - F.min("_cc"), F.max("_cr") - F.min("_cr")).alias("_span"))
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_size"))
    areas = materialise(spans.join(shuffled(sizes), keys), "areas")
    widest = (areas.agg(F.max("_span")).first()[0] or 0) + 1
    cells = spread_join(cells, areas, keys)
    todo, out, ring = cells, None, 1
    while True:
        # Parents are few; fine cells meet them only after neighbours are listed per parent. Small areas list all they have.
        parents = todo.select(*keys, "_pc", "_pr", "_span", "_size").distinct()
        few = F.col("_size") <= k
        reach_of = F.least(F.lit(ring), F.col("_span"))
        span = F.sequence(-reach_of, reach_of)
        around = parents.where(~few).withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span))
        around = around.withColumns({"_cc": F.col("_pc") + F.col("_i"), "_cr": F.col("_pr") + F.col("_j")})
        near = around.join(shuffled(known), [*keys, "_cc", "_cr"]).select(*keys, "_pc", "_pr", "_cc", "_cr", *values)
        whole = parents.where(few).join(shuffled(known), keys).select(*near.columns)
        pairs = todo.join(shuffled(near.unionByName(whole)), [*keys, "_pc", "_pr"])
        # exact integer distance in half fine cells
        dx = (F.col("_cc") * 2 + 1) * ratio - (F.col("col") * 2 + 1)
        dy = (F.col("_cr") * 2 + 1) * ratio - (F.col("row") * 2 + 1)
        pairs = pairs.withColumn("_d2", (dx.cast("bigint") * dx + dy.cast("bigint") * dy))
        top = best_per_key(pairs, [*keys, "col", "row"], [F.asc("_d2"), F.asc("_cc"), F.asc("_cr")], k, "_place")
        weight = F.when(F.col("_d2") > 0, 1.0 / F.col("_d2"))
        aggs = [F.count("*").alias("_n"), F.max("_d2").alias("_far"), exact_sum(weight, 12).alias("_w"),
                F.min_by(F.struct("_cc", "_cr", "_d2", *values), "_place").alias("_first")]
        aggs += [exact_sum(weight * F.col(v), 12).alias(f"_s_{v}") for v in values]
        got = top.groupBy(*keys, "col", "row", "_pc", "_pr", "_span", "_size").agg(*aggs)
        reach = (2 * ring + 1) * ratio + 1
        settled = (F.col("_size") <= k) | (F.col("_span") <= ring) | ((F.col("_n") >= k) & (F.col("_far") <= reach * reach))
        step = materialise(todo.join(shuffled(got), [*keys, "col", "row", "_pc", "_pr", "_span", "_size"], "left"), "interpolated")
        done = step.where(F.coalesce(settled, F.lit(False)) & F.col("_n").isNotNull())
        out = done if out is None else out.unionByName(done)
        todo = step.where(~F.coalesce(settled, F.lit(False))).select(*todo.columns)
        if ring >= widest or todo.isEmpty():
            break
        ring *= 2
    at_centre = F.col("_first._d2") == 0
    out = out.withColumns({
        v: round_dp(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(at_centre, F.col(f"_first.{v}")).otherwise(
            F.try_divide(f"_s_{v}", "_w")))), 4) for v in values})
    contained = known.select(*keys, F.col("_cc").alias("_pc"), F.col("_cr").alias("_pr"), F.lit(True).alias("_has"))
    out = out.join(shuffled(contained), [*keys, "_pc", "_pr"], "left")
    return out.select(
        *keys, "col", "row", *values,
        F.when(F.col("_has"), F.col("_pc")).otherwise(F.col("_first._cc")).alias("parent_col"),
        F.when(F.col("_has"), F.col("_pr")).otherwise(F.col("_first._cr")).alias("parent_row"))
