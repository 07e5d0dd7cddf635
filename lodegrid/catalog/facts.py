"""Assembled facts, evidence lines, streams and end-to-end plans."""
from __future__ import annotations

import re
from functools import cached_property, partial

from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.catalog import sqlmath as q
from lodegrid.catalog.evidence import _AREQ, _NATIVE
from lodegrid.catalog import clipped, names  # noqa: F401
from lodegrid.catalog.geometry import aoi_cells, of_all_areas, overlay_sql, polygon_edges
from lodegrid.catalog.names import _REACH
from lodegrid.catalog.nearby import KEYS, _CELLS, _FACTS, _PAIRS, Near, framed
from lodegrid.catalog.registry import ORACLES, QUERIES, register
from lodegrid.catalog.scoring import WEIGHTS, _FUSED
from lodegrid.catalog.views import table, view, with_views
from lodegrid.functions import geo, grid as g
from lodegrid.operators import context, describe, lines as ln, overlay, spatial, toponyms as tp, wofe
from lodegrid.plans import analysis
from lodegrid.session import materialise, shuffled


@register("lithology_lines", f"""{_AREQ}, t1 AS (SELECT rc, rr, arg_min(geol_unit, place) AS unit FROM rk GROUP BY 1, 2),
  fm AS (SELECT unnest(['{"','".join(fixed.CONTRASTS)}']) AS u, unnest(['{"','".join(v[3].replace("'", "''") for v in fixed.CONTRASTS.values())}']) AS formation)
  SELECT rc AS col, rr AS row, CASE WHEN favourable_unit IS NOT NULL THEN 'ranked unit ' || favourable_unit || ': contrast ' || favourable_contrast || ', ' || formation || ', over ' ||
  CAST(floor({q.rd('fav / total', 3)} * 100 + 0.5e0) AS INT) || '% of the cell' WHEN unit IS NOT NULL THEN 'raster unit ' || unit || ' holds no training site' ELSE 'no data' END AS line
  FROM co LEFT JOIN tot USING (rc, rr) LEFT JOIN t1 USING (rc, rr) LEFT JOIN fm ON fm.u = favourable_unit""")
def _(spark, d):
    none = F.array().cast("array<struct<unit:string,name:string,lithology:string,frac:double>>")
    text = describe.render("lithology", describe.rock_facts(none, F.col("w")))
    return unit_rows(spark, d).select(F.col("c").alias("col"), F.col("r").alias("row"), describe.or_no_data(text).alias("line"))


def unit_rows(spark, d):
    cells = view(spark, d, "wofe_cell")
    req = cells.select(F.lit(1000).alias("res"), F.floor(F.col("col") / 4).cast("int").alias("col"),
                       F.floor(F.col("row") / 4).cast("int").alias("row")).distinct().withColumns({"c": F.col("col"), "r": F.col("row")})
    rows = wofe.unit_facts(req, cells, ["c", "r"])
    return describe.assemble(req, ["c", "r"], {"w": rows})


def _list(table_, col):
    return f"(SELECT string_agg(CASE x {' '.join(f'WHEN {k} THEN ' + chr(39) + v + chr(39) for k, v in table_.items())} ELSE 'code ' || x END, ', ' ORDER BY i) FROM (SELECT unnest(string_split({col}, ',')) AS s, unnest(range(1, 20)[1:len(string_split({col}, ','))]) AS i, CAST(s AS INT) AS x))"


_NO_LINES = ("struct<count:bigint,kinds:array<struct<kind:string,n:bigint,km:double>>,azimuths:array<double>,favourable_azimuths:array<double>,"
             "named:array<string>,nearest_km:double,nearest_kind:string,fault_intersections_in_cell:bigint>")


@register("raster_structure_lines", f"""{_AREQ} SELECT rc AS col, rr AS row, coalesce(nullif(concat_ws('; ',
  CASE WHEN fault_codes <> '' THEN 'raster faults: ' || {_list(fixed.FAULT_TYPES, 'fault_codes')} || CASE WHEN has_predictor_fault THEN ', a predicting kind among them' ELSE '' END END,
  CASE WHEN fold_codes <> '' THEN 'raster folds: ' || {_list(fixed.FOLD_TYPES, 'fold_codes')} END,
  CASE WHEN dike_units <> '' THEN 'raster dikes: ' || replace(dike_units, ',', ', ') END, CASE WHEN fault_codes <> '' THEN 'the raster tells presence only and no trend' END), ''), 'no data') AS line FROM co""")
def _(spark, d):
    text = describe.render("structure", describe.line_facts(F.lit(None).cast(_NO_LINES), F.col("w")))
    return unit_rows(spark, d).select(F.col("c").alias("col"), F.col("r").alias("row"), describe.or_no_data(text).alias("line"))


# District polygons stand at the place names; what they yielded, and when, follows from their number.
_DISTRICT = f"""dis AS (SELECT aoi_id, col, row, feature_id, km, inside, CASE WHEN feature_id % 4 > 0 THEN (feature_id % 90) || ' t of ore' END AS output,
  (1880 + feature_id % 40) || CASE WHEN feature_id % 3 > 0 THEN ' to ' || (1880 + feature_id % 40 + feature_id % 3 * 10) ELSE '' END AS years FROM ({ORACLES['cell_district']}) WHERE feature_id IS NOT NULL)"""
_DIST_TEXT = "CASE WHEN inside THEN 'in district ' || feature_id ELSE 'district ' || feature_id || ' at ' || km || ' km' END"


def districts(spark, d, cells=None):
    """The nearest district of each cell with its history; cells without one are not listed."""
    k = F.col("feature_id")
    return names.district_rows(spark, d, cells).where("feature_id IS NOT NULL").select(
        *KEYS, k.alias("name"), "inside", "km", F.when(k % 4 > 0, F.concat((k % 90).cast("string"), F.lit(" t of ore"))).alias("production"),
        (1880 + k % 40).alias("first_year"), (1880 + k % 40 + k % 3 * 10).alias("last_year"))


@register("proximity_lines", f"""{_FACTS}, acc AS (SELECT aoi_id, col, row, accuracy_class AS na FROM rn WHERE nth = 1), {_DISTRICT}
  SELECT aoi_id, col, row, concat_ws('; ', CASE WHEN nearest_km IS NULL THEN 'no record within 5 km' ELSE 'nearest record ' || nearest_name || ', ' || nearest_km || ' km' ||
  CASE WHEN na IN ('variable', 'district_centroid', 'unknown') THEN ', its position too rough to argue from' ELSE '' END END,
  CASE WHEN nearest_km IS NOT NULL THEN 'records: ' || n_in_cell || ' in the cell, ' || n_1km || ' to 1 km, ' || n_2km || ' to 2 km, ' || n_near || ' to 5 km' END,
  CASE WHEN nearest_km IS NOT NULL THEN with_production || ' of them produced, ' || with_assays || ' were assayed' END, {_DIST_TEXT},
  CASE WHEN n_near > 0 THEN least(n_near, 3) || ' surveyed workings to 5 km' END) AS line FROM facts LEFT JOIN acc USING (aoi_id, col, row) LEFT JOIN dis USING (aoi_id, col, row)""")
def _(spark, d):
    rows = assembled(spark, d, ("occurrences", "district", "workings"))
    known = {**describe.site_facts(F.col("occurrences")), **describe.district_facts(F.col("district")), "workings": F.size("workings.list")}
    return of_all_areas(spark, d, rows.select(*KEYS, describe.render("proximity", known).alias("line")))


_HITS = f"""{_REACH} SELECT aoi_id, col, row, name, tier, corroboration, row_number() OVER (PARTITION BY aoi_id, col, row ORDER BY tier, distance_km, feature_id) AS place
  FROM hits WHERE tier <> 5 QUALIFY place <= 3"""


@register("historical_lines", f"""{_FACTS}, {_DISTRICT}, full1 AS (SELECT aoi_id, col, row, place, name || ' ' || {q.rd('dm / 1000', 2)} || ' km (' || concat_ws(', ', CASE WHEN production THEN 'produced' END,
  CASE WHEN assays THEN 'assayed' END, CASE accuracy_class {' '.join(f"WHEN '{k}' THEN '" + v.replace("'", "''") + "'" for k, v in fixed.POSITION_LABELS.items())} END) || ')' AS best FROM rn WHERE place = 1),
  three AS (SELECT aoi_id, col, row, string_agg(name || ' ' || {q.rd('dm / 1000', 2)} || ' km', ', ' ORDER BY nth) AS list FROM rn WHERE nth <= 3 GROUP BY 1, 2, 3),
  seen AS (SELECT aoi_id, col, row, string_agg(name || ' ' || {q.rd('dm / 1000', 2)} || ' km', ', ' ORDER BY i) AS pins FROM (
    SELECT *, row_number() OVER (PARTITION BY aoi_id, col, row ORDER BY dm, site_id) AS i FROM near WHERE site_id % 11 = 0) WHERE i <= 3 GROUP BY 1, 2, 3),
  named AS (SELECT aoi_id, col, row, string_agg(name || ' (tier ' || tier || ', ' || corroboration || ')', ', ' ORDER BY place) AS names FROM ({_HITS}) GROUP BY 1, 2, 3)
  SELECT aoi_id, col, row, concat_ws('; ', CASE WHEN nearest_km IS NULL THEN 'no recorded site within 5 km' ELSE n_near || ' recorded sites to 5 km, ' || n_in_cell || ' of them in the cell, ' || with_assays ||
  ' assayed, ' || with_production || ' with production' END, CASE WHEN best_name IS NOT NULL THEN 'best documented: ' || best END, {_DIST_TEXT},
  coalesce('the district yielded ' || output || ' in ' || years, 'the district was worked in ' || years), 'surveyed workings: ' || list, 'seen in the field: ' || pins, 'place names: ' || names) AS line
  FROM facts LEFT JOIN full1 USING (aoi_id, col, row) LEFT JOIN dis USING (aoi_id, col, row) LEFT JOIN three USING (aoi_id, col, row) LEFT JOIN seen USING (aoi_id, col, row) LEFT JOIN named USING (aoi_id, col, row)""")
def _(spark, d):
    rows = assembled(spark, d, ("occurrences", "district", "workings", "toponyms", "field_observations"))
    b, t = F.col("occurrences.best"), F.col("district")
    best = F.when(b.isNotNull(), describe.record_text(b["name"], b["km"], b["production"], b["assays"], b["accuracy_class"], F.lit(None).cast("int")))
    known = {**describe.site_facts(F.col("occurrences")), "best": best, **describe.district_facts(t),
             **describe.district_history(t["production"], t["first_year"], t["last_year"]),
             **describe.nearby_facts(F.col("workings.list"), F.col("field_observations.list"), F.col("toponyms.list"))}
    return of_all_areas(spark, d, rows.select(*KEYS, describe.render("historical", known).alias("line")))


@register("geochemistry_remote_lines", """WITH r AS (SELECT o_custkey AS k, o_orderkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS ore, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS gangue FROM orders),
  o AS (SELECT k, ore, min(i) AS f FROM r WHERE ore <> '' GROUP BY 1, 2), g AS (SELECT k, gangue, min(i) AS f FROM r WHERE gangue IS NOT NULL GROUP BY 1, 2), ks AS (SELECT DISTINCT k FROM r),
  oo AS (SELECT k, array_to_string(list(ore ORDER BY f)[1:3], ', ') AS ores FROM o GROUP BY 1), gg AS (SELECT k, array_to_string(list(gangue ORDER BY f)[1:2], ', ') AS gs FROM g GROUP BY 1)
  SELECT k, concat_ws('; ', 'ore minerals on record: ' || ores, 'gangue on record: ' || gs, CASE WHEN k % 5 > 0 THEN (k % 5) || ' sites to 5 km were assayed, the values are in their documents' END, 'host rock: U' || k || ' tuff') AS geochemistry,
  concat_ws('; ', 'host rock: U' || k || ' tuff 60%', 'gangue on record: ' || gs) AS remote FROM ks LEFT JOIN oo USING (k) LEFT JOIN gg USING (k)""")
def _(spark, d):
    first = lambda c: F.min(F.when(F.nullif(c, F.lit("")).isNotNull(), F.col("o_orderkey")))
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("ore_minerals"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("gangue"))
    # A mineral stands once per site, so lists hold as many rows as there are minerals.
    each = o.groupBy("k", "ore_minerals", "gangue").agg(F.min("o_orderkey").alias("first"))
    rows = each.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("first", "ore_minerals", "gangue"))).alias("records"))
    units = F.array(F.struct(F.concat(F.lit("U"), F.col("k").cast("string")).alias("unit"), F.lit(None).cast("string").alias("name"), F.lit("tuff").alias("lithology"), F.lit(0.6).alias("frac")))
    no_raster = F.lit(None).cast("struct<favourable_unit:string,favourable_frac:double,favourable_contrast:double,formation:string,unit:string>")
    known = {**describe.record_facts(F.col("records"), F.col("k") % 5), **describe.rock_facts(units, no_raster)}
    return rows.select("k", describe.render("geochemistry", known).alias("geochemistry"), describe.render("remote_sensing", known).alias("remote"))


@register("structure_lines", f"""WITH s AS ({ORACLES['cell_structures']}), x AS ({ORACLES['fault_crossings_all']})
  SELECT aoi_id, col, row, concat_ws('; ', CASE WHEN count > 0 THEN count || ' mapped lines within 1.7 km: ' ||
    list_aggregate(list_transform(string_split(kinds, '|'), lambda k: split_part(k, ' ', 2) || ' ' || split_part(k, ' ', 1) || ' from ' || split_part(k, ' ', 3) || ' km'), 'string_agg', ', ')
    ELSE 'no mapped line within 1.7 km, a ' || nearest_kind || ' is nearest at ' || nearest_km || ' km' END,
  CASE WHEN azimuths <> '' THEN 'trends ' || replace(azimuths, '|', ', ') || CASE WHEN favourable_azimuths <> '' THEN ', favourable among them ' || replace(favourable_azimuths, '|', ', ') ELSE ', none of them favourable' END END,
  fault_intersections_in_cell || ' pairs of faults meet in the cell', 'names: ' || replace(named, '|', ', ')) AS line FROM s LEFT JOIN x USING (aoi_id, col, row)""")
def _(spark, d):
    rows = assembled(spark, d, ("structures",))
    s = F.col("structures")
    none = F.lit(None).cast("struct<fault_codes:array<int>,fold_codes:array<int>,dike_units:array<string>,has_predictor_fault:boolean>")
    return of_all_areas(spark, d, rows.select(*KEYS, describe.render("structure", describe.line_facts(s, none)).alias("line")))


@register("cell_centre_lines", f"""{with_views('aoi')}, {q.square_aoi()} SELECT aoi_id, '  - c' || aoi_id || ': center (' || printf('%.4f', {q.rd('(s + n) / 2')}) || ', ' || printf('%.4f', {q.rd('(w + e) / 2')}) || ')' AS line,
  'Bounding box: ' || printf('%.4f', {q.rd('s')}) || '°N to ' || printf('%.4f', {q.rd('n')}) || '°N, ' || printf('%.4f', {q.rd('abs(w)')}) || '°W to ' || printf('%.4f', {q.rd('abs(e)')}) || '°W' AS box FROM box""")
def _(spark, d):
    names = ("min_lon", "min_lat", "max_lon", "max_lat")
    out = view(spark, d, "aoi").select("aoi_id", geo.square_around(F.col("lon"), F.col("lat"), F.col("radius_km")).alias("b")).select("aoi_id", "b.*")
    cols = [F.col(c) for c in names]
    return out.select("aoi_id", describe.cell_line(F.concat(F.lit("c"), F.col("aoi_id").cast("string")), *cols).alias("line"), describe.bbox_text(*cols).alias("box"))


# --- the nine fact tables -----------------------------------------------------------------------
# Each table is told for the cells of outlines; what does not depend on the area is found once per cell of the grid.
class Known:
    """Steps that several fact tables read, each taken once: cells of outlines in their frames, records near them and the first of these."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    @cached_property
    def cells(self):
        return framed(self.spark, self.d)

    @cached_property
    def grid_cells(self):
        return materialise(self.cells.select(*spatial.SQUARE).distinct(), "grid-cells")

    @cached_property
    def pairs(self):
        return Near(self.spark, self.d, cells=self.cells)

    @cached_property
    def near(self):
        return self.pairs.told()

    def told(self, rows):
        """Facts of cells of the grid for every outline that has the cell."""
        return self.cells.select("aoi_id", *spatial.SQUARE).join(shuffled(rows), spatial.SQUARE).drop("res")


def _geology(k):
    parts = overlay.polygon_cells(polygon_edges(k.spark, k.d), ["feature_id", "unit"], 4000)
    shares = overlay.unit_shares(k.grid_cells, parts, spatial.SQUARE, "unit")
    return k.told(shares.groupBy(*spatial.SQUARE).agg(F.array_sort(F.collect_list(F.struct("place", "unit", "frac"))).alias("units")))


def _structures(k):
    return names.structures(k.spark, k.d, crossings=True, cells=k.cells)


def _raster(k):
    cells = k.grid_cells.withColumns({"z": F.col("res"), "c": F.col("col"), "r": F.col("row")})
    rows = wofe.unit_facts(cells, view(k.spark, k.d, "wofe_cell"), ["z", "c", "r"])
    return k.told(rows.withColumnsRenamed({"z": "res", "c": "col", "r": "row"}))


def _three(rows):
    """At most three records per cell, nearest first."""
    return spatial.nearest_records(rows, KEYS).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("place", "name", "km"))).alias("list"))


def _toponyms(k):
    _, hits = names.reach_hits(k.spark, k.d, k.grid_cells)
    top = tp.top_hits(hits, spatial.SQUARE).groupBy(*spatial.SQUARE)
    return k.told(top.agg(F.array_sort(F.collect_list(F.struct("place", "name", "tier", "corroboration"))).alias("list")))


def _novelty(k):
    return k.pairs.novelty(k.near).select(*KEYS, "nearest_occurrence_km", "novelty").where("novelty IS NOT NULL")


FACT_TABLES = {
    "geology": _geology, "structures": _structures, "wofe": _raster, "occurrences": lambda k: k.pairs.facts(k.near), "district": lambda k: districts(k.spark, k.d, k.cells),
    "workings": lambda k: _three(k.near), "toponyms": _toponyms,
    "field_observations": lambda k: _three(k.pairs.nearest(where="site_id % 11 = 0")), "novelty": _novelty,
}


def assembled(spark, d, which=tuple(FACT_TABLES)):
    """Cells of outlines with the wanted fact tables, each stored in buckets of cells and joined as it lies."""
    known = Known(spark, d)
    cells = describe.stored(known.cells.select(*KEYS), KEYS, "cells")
    return describe.assemble(cells, KEYS, {n: describe.stored(FACT_TABLES[n](known), KEYS, n) for n in which})


def _having(sql, where="true"):
    return f"(SELECT DISTINCT aoi_id, col, row FROM ({sql}) WHERE {where})"


_PIECES = {
    "geology": _having(f"{with_views('aoi', 'place_name')}, {q.square_aoi()}, {q.cover_ctes(4000)}, {overlay_sql(4000)}, u AS (SELECT col, row, unit, {q.fsum('greatest(f, 0)')} AS s FROM frac WHERE f > 1e-9 GROUP BY 1, 2, 3) SELECT * FROM cells JOIN u USING (col, row)", f"{q.rd('s', 3)} > 0"),
    "structures": _having(ORACLES["cell_structures"]),
    "wofe": _having(f"{with_views('aoi', 'wofe_cell')}, {q.square_aoi()}, {q.cover_ctes(4000)} SELECT aoi_id, c.col, c.row FROM cells c JOIN (SELECT DISTINCT col // 16 AS col, row // 16 AS row FROM wofe_cell) USING (col, row)"),
    "occurrences": _having(f"{_FACTS} SELECT * FROM facts"),
    "district": _having(ORACLES["cell_district"], "feature_id IS NOT NULL"),
    "workings": _having(ORACLES["cell_nearest_workings"]),
    "toponyms": _having(_HITS),
    "field_observations": _having(f"{_PAIRS} SELECT * FROM near WHERE site_id % 11 = 0"),
    "novelty": _having(ORACLES["cell_novelty"], "novelty IS NOT NULL"),
}


@register("facts_assembled", f"""{_CELLS} SELECT aoi_id, count(*) AS cells_total, {', '.join(f"count(t{i}.col) AS cells_with_{n}" for i, n in enumerate(_PIECES))} FROM cells c
  {' '.join(f"LEFT JOIN {sql} t{i} ON t{i}.aoi_id = c.aoi_id AND t{i}.col = c.col AND t{i}.row = c.row" for i, sql in enumerate(_PIECES.values()))} GROUP BY 1""".replace("SELECT aoi_id, count(*)", "SELECT c.aoi_id, count(*)"))
def _(spark, d):
    return of_all_areas(spark, d, describe.census(assembled(spark, d), ["aoi_id"], list(FACT_TABLES)))


# --- what a cell's score was based on -----------------------------------------------------------
def _sums_sql(sql, columns, keys="aoi_id, col, row"):
    text = " || chr(1) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(2))" for c in sorted(columns))
    number = lambda place: f"sum(CAST(CAST('0x' || substr(h, {place}, 15) AS BIGINT) AS HUGEINT))"
    return f"SELECT {keys}, count(*) || ':' || {number(1)} || ':' || {number(16)} AS part FROM (SELECT {keys}, sha256({text}) AS h FROM ({sql})) GROUP BY {keys}"


def _nearest_three(spark, d):
    facts = Near(spark, d)
    return facts, materialise(facts.nearest(3), "nearest")


def _context_tables(spark, d, facts, near, mark=None):
    """Facts of the cells of outlines, and of areas; with ``mark`` every fiftieth record is renamed and every tenth area relabelled."""
    renamed = F.col("name") if mark is None else F.when(F.col("site_id") % 50 == 0, F.concat("name", F.lit(mark))).otherwise(F.col("name"))
    label = F.col("label") if mark is None else F.when(F.col("aoi_id") % 10 == 0, F.concat("label", F.lit(mark))).otherwise(F.col("label"))
    told = near.withColumn("name", renamed)
    known = facts.novelty(near).select(*KEYS, "nearest_occurrence_km", "novelty")
    cells = {"workings": spatial.nearest_records(told, KEYS).select(*KEYS, "place", "name", "km"), "novelty": known}
    return cells, {"area": view(spark, d, "aoi").select("aoi_id", label.alias("label"), "toponym_revealing")}


def _contexts(spark, d, facts, near, mark=None):
    cells, areas = _context_tables(spark, d, facts, near, mark)
    return context.context_hashes(facts.cells.select(*KEYS), KEYS, cells, "aoi_id", areas, partial(of_all_areas, spark, d))


@register("context_hashes", f"""{_CELLS}, w AS ({_sums_sql(ORACLES['cell_nearest_workings'], ['place', 'name', 'km'])}),
  n AS ({_sums_sql(ORACLES['cell_novelty'], ['nearest_occurrence_km', 'novelty'])}), a AS ({_sums_sql('SELECT aoi_id, label, toponym_revealing FROM aoi', ['label', 'toponym_revealing'], 'aoi_id')})
  SELECT c.aoi_id, c.col, c.row, sha256(sha256(concat_ws('|', 'novelty:' || n.part, 'workings:' || w.part)) || '/' || sha256('area:' || a.part)) AS context_hash
  FROM cells c LEFT JOIN w USING (aoi_id, col, row) LEFT JOIN n USING (aoi_id, col, row) LEFT JOIN a ON a.aoi_id = c.aoi_id""")
def _(spark, d):
    return _contexts(spark, d, *_nearest_three(spark, d))


@register("cells_to_rescore", f"""{_PAIRS}, three AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY aoi_id, col, row ORDER BY dm, site_id) <= 3)
  SELECT DISTINCT aoi_id, col, row FROM cells LEFT JOIN (SELECT DISTINCT aoi_id, col, row, true AS hit FROM three WHERE site_id % 50 = 0) USING (aoi_id, col, row) WHERE hit OR aoi_id % 10 = 0""")
def _(spark, d):
    """Some records are renamed and some areas relabelled after scoring: only cells that were told of them are scored again."""
    known = _nearest_three(spark, d)
    return context.cells_to_rescore(_contexts(spark, d, *known), _contexts(spark, d, *known, " (renamed)"), KEYS)


# --- streams ------------------------------------------------------------------------------------
_COST = q.rd("(input_tokens * 300 + output_tokens * 1500) / 1e8", 6)
_WIN = f"""{with_views('telemetry')} SELECT date_trunc('hour', ts) AS window_start, run_id, agent_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum({q.fx(_COST, 6)}) AS DOUBLE) / 1e6 AS est_cost_usd FROM telemetry GROUP BY 1, 2, 3"""


@register("usage_windows_batch", _WIN)
def _(spark, d):
    from lodegrid.streaming.pipelines import windowed_usage
    calls = view(spark, d, "telemetry").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_usage(calls).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("usage_windows_stream", _WIN)
def _(spark, d):
    """The same rollup as a stream over landed files, run until all input is taken: changed windows are merged as they come,
    and state is dropped once the watermark has passed."""
    from lodegrid.session import scratch_path
    from lodegrid.sinks.tablelog import TableLog
    from lodegrid.streaming.pipelines import read_calls, windowed_usage
    landed, out = scratch_path(spark, "calls"), scratch_path(spark, "usage")
    calls = view(spark, d, "telemetry").withColumn("ts", F.col("ts").cast("timestamp"))
    calls.coalesce(4).write.json(landed)
    stream = windowed_usage(read_calls(spark, landed))
    # Counts of a window only grow, so the larger row is the newer one.
    of = lambda s: TableLog(s, out, stream.schema, ["window_start", "run_id", "agent_id"], ["calls"])
    merge = lambda batch, number: of(batch.sparkSession).merge(batch, ("usage", number))
    query = stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    return of(spark).read().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_PHASES = "CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'complete' ELSE event_type END"
_STATES = "CASE WHEN event_type IN ('view', 'click') THEN CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' ELSE 'failed' END END"
_SESSIONS = f"""WITH e AS (SELECT event_id, ts, user_id AS run_id, {_PHASES} AS phase, {_STATES} AS status, CASE WHEN event_type = 'view' THEN event_id % 50 END AS cells, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events),
  g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM e),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n FROM g)
  SELECT run_id, min(ts) AS started_at, max(ts) AS last_event_at, count(*) AS events, count(status) AS batches, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'partial') AS partial,
  count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(cells), 0) AS BIGINT) AS cells_scored, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
  arg_max(phase, (ts, event_id)) AS last_phase, CASE WHEN arg_max(phase, (ts, event_id)) = 'complete' THEN 'complete' ELSE 'expired' END AS state FROM s GROUP BY run_id, n"""


def run_events(spark, d):
    return table(spark, d, "events").selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id AS run_id", f"{_PHASES} AS phase", f"{_STATES} AS status",
        "CASE WHEN event_type = 'view' THEN event_id % 50 END AS cells", "CAST(floor(value * 100) AS BIGINT) AS tokens")


def _local_times(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_event_at")})


@register("run_sessions", _SESSIONS)
def _(spark, d):
    from lodegrid.streaming.pipelines import run_sessions
    return _local_times(run_sessions(run_events(spark, d), "6 hours"))


@register("run_sessions_stream", _SESSIONS)
def _(spark, d):
    """The same as a stream: each landing is a batch, and sessions come out as the watermark passes them. A last event, long after, closes what is open."""
    from lodegrid.session import scratch_path
    from lodegrid.streaming.pipelines import read_events, run_sessions
    landed, out = scratch_path(spark, "events"), scratch_path(spark, "sessions")
    events = materialise(run_events(spark, d), "events")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    middle = span["a"] + (span["b"] - span["a"]) / 2
    land = lambda df, name: df.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{landed}/{name}")
    land(events.where(F.col("ts") < F.lit(middle)), 1)
    land(events.where(F.col("ts") >= F.lit(middle)), 2)
    closing = events.limit(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(span["b"]).alias("ts") + F.expr("INTERVAL 30 DAYS"), F.lit(-1).cast("bigint").alias("run_id"))
    land(closing.toDF("event_id", "ts", "run_id"), 3)
    for part in (1, 2, 3):  # one landing at a time, as they come; the query goes on from its checkpoint
        stream = run_sessions(read_events(spark, f"{landed}/{{{','.join(str(i) for i in range(1, part + 1))}}}"), "6 hours", "1 day")
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start(out).awaitTermination()
    return _local_times(spark.read.schema(stream.schema).parquet(out).where("run_id >= 0"))


# --- plans --------------------------------------------------------------------------------------
def _rings(spark, d):
    box = geo.square_around(F.col("lon"), F.col("lat"), F.col("radius_km"))
    return overlay.box_rings(view(spark, d, "aoi"), ["aoi_id"], box)


def _scores(spark, d, res):
    """Scorer rows of the table, each told for the cells of its area that its key falls on."""
    keyed = aoi_cells(spark, d, res).withColumn("cell_key", (F.col("col") * 7 + F.col("row") * 13) % 100)
    rows = view(spark, d, "agent_score").withColumn("written", F.struct("ord1", "ord2", "ord3")).drop("ord1", "ord2", "ord3")
    return keyed.join(rows, ["aoi_id", "cell_key"]).select("aoi_id", "col", "row", "agent_id", "score", "confidence", "written")


_FACTS8 = re.sub(r"\b4000\b", "8000", _FACTS)
_W4 = lambda v: f"CASE WHEN min(d2) = 0 THEN arg_min({v}, k) ELSE least(1e0, greatest(0e0, {q.fsum(f'{v} / d2', 12)} / {q.fsum('1e0 / d2', 12)})) END"


@register("analysis_end_to_end", f"""WITH coarse AS (SELECT c.aoi_id, c.col, c.row, coalesce(f.score, 0e0) AS score, coalesce(f.confidence, 0e0) AS confidence
    FROM ({with_views('aoi')}, {q.square_aoi()}, {q.cover_ctes(8000)} SELECT * FROM cells) c LEFT JOIN ({_FUSED} SELECT * FROM fused) f ON f.aoi_id = c.aoi_id AND f.cell_key = (c.col * 7 + c.row * 13) % 100),
  fine AS (SELECT * FROM ({with_views('aoi')}, {q.square_aoi()}, {q.cover_ctes(4000)} SELECT * FROM cells)),
  met AS (SELECT f.aoi_id, f.col, f.row, c.col AS cc, c.row AS cr, score, confidence, pow((c.col * 2 + 1) * 2 - (f.col * 2 + 1), 2) + pow((c.row * 2 + 1) * 2 - (f.row * 2 + 1), 2) AS d2 FROM fine f JOIN coarse c USING (aoi_id)),
  nn AS (SELECT *, row_number() OVER (PARTITION BY aoi_id, col, row ORDER BY d2, cc, cr) AS k FROM met QUALIFY k <= 4),
  shown AS (SELECT aoi_id, col, row, {q.rd(_W4('score'))} AS score, {q.rd(_W4('confidence'))} AS confidence, arg_min(cc, k) AS nc, arg_min(cr, k) AS nr FROM nn GROUP BY 1, 2, 3),
  up AS (SELECT s.*, coalesce(c.col, nc) AS pc, coalesce(c.row, nr) AS pr FROM shown s LEFT JOIN coarse c ON c.aoi_id = s.aoi_id AND c.col = s.col // 2 AND c.row = s.row // 2),
  pos AS (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi, count(*) OVER p AS n, rank() OVER (PARTITION BY aoi_id ORDER BY score) - 1 AS below, count(*) OVER (PARTITION BY aoi_id, score) AS tied FROM up WINDOW p AS (PARTITION BY aoi_id)),
  ranked AS (SELECT *, CASE WHEN hi - lo > 1e-9 THEN {q.rd('(score - lo) / (hi - lo)')} ELSE 0.5e0 END AS relative_score, {q.rd('(below + tied / 2e0) / n')} AS percentile FROM pos),
  near8 AS (SELECT * FROM ({_FACTS8} SELECT aoi_id, col, row, nearest_km FROM facts))
  SELECT r.aoi_id, r.col, r.row, score, confidence, relative_score, percentile, CASE WHEN hi - lo <= 1e-9 THEN 'low' WHEN percentile >= 0.9e0 THEN 'high' WHEN percentile >= 0.65e0 THEN 'medium' WHEN percentile >= 0.35e0 THEN 'low' ELSE 'negligible' END AS tier,
    nearest_km AS nearest_occurrence_km, CASE WHEN nearest_km <= 0.5 THEN 'confirms' WHEN nearest_km <= 2 THEN 'extends' WHEN nearest_km IS NOT NULL THEN 'lead' END AS novelty
  FROM ranked r LEFT JOIN near8 n ON n.aoi_id = r.aoi_id AND n.col = pc AND n.row = pr""")
def _(spark, d):
    job = analysis.Analysis(analysis_res=8000, display_res=4000, weights=WEIGHTS)
    out = analysis.analyse(_rings(spark, d), view(spark, d, "occurrence"), _scores(spark, d, 8000), job)
    return out.select("aoi_id", "col", "row", "score", "confidence", "relative_score", "percentile", "tier", "nearest_occurrence_km", "novelty")


@register("baseline_over_areas", f"""{_NATIVE}, n8 AS (SELECT col // 32 AS col, row // 32 AS row, count(*) AS n, count(*) FILTER (tract = 'favourable') AS nf, count(*) FILTER (tract = 'permissive') AS np,
    count(*) FILTER (tract = 'non_permissive') AS nn FROM nat GROUP BY 1, 2),
  c8 AS (SELECT aoi_id, coalesce(n, 0) AS n, coalesce(n, 0) / 1024e0 AS cov, CASE WHEN nf >= np AND nf >= nn THEN 'favourable' WHEN np >= nn THEN 'permissive' ELSE 'non_permissive' END AS tract
    FROM ({with_views('aoi')}, {q.square_aoi()}, {q.cover_ctes(8000)} SELECT * FROM cells) c LEFT JOIN n8 USING (col, row))
  SELECT aoi_id, count(*) AS cells, count(*) FILTER (cov >= 0.5) AS scored, {q.rd('count(*) FILTER (cov >= 0.5) / count(*)')} AS coverage, count(*) FILTER (n = 0) AS refused_outside,
    count(*) FILTER (n > 0 AND cov < 0.5) AS refused_partial, {', '.join(f"count(*) FILTER (cov >= 0.5 AND tract = '{t}') AS {t}" for t in fixed.TRACTS)} FROM c8 GROUP BY 1""")
def _(spark, d):
    out = analysis.baseline(_rings(spark, d), view(spark, d, "wofe_cell"), 8000)
    return wofe.refusal_report(out, ["aoi_id"])
