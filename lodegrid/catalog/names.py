"""Place-name and structure-line queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.catalog import sqlmath as q
from lodegrid.catalog.geometry import _poly_sql, aoi_cells, of_all_areas, outline_cells, overlay_sql, polygon_edges, polygons
from lodegrid.catalog.nearby import framed
from lodegrid.catalog.registry import register
from lodegrid.catalog.views import view, with_views
from lodegrid.functions import geo, grid as g
from lodegrid.functions.scalars import round_dp
from lodegrid.operators import lines as ln, overlay, spatial, toponyms as tp
from lodegrid.operators.toponyms import Lexicon
from lodegrid.session import materialise, shuffled

LEX = Lexicon(
    terms={1: ("gear",), 2: ("red", "blue"), 3: ("plate",), 4: ("cold",), 5: ("red gear", "cold plate")},
    excluded=("Civil",), landforms=("Summit", "Ridge"))
KEYS = ["aoi_id", "col", "row"]


def _re(t):
    return f"regexp_matches(name, '(?i)\\b{t}\\b')"


_MATCH = f"""{{views}}, matched AS (SELECT * FROM (SELECT *, CASE WHEN feature_class = 'Civil' THEN NULL
  WHEN {_re('cold plate')} THEN 'cold plate' WHEN {_re('red gear')} THEN 'red gear' WHEN {_re('gear')} THEN 'gear' WHEN {_re('blue')} THEN 'blue'
  WHEN {_re('red')} THEN 'red' WHEN {_re('plate')} THEN 'plate' WHEN {_re('cold')} AND feature_class IN ('Summit', 'Ridge') THEN 'cold' END AS matched_term FROM place_name)
  WHERE matched_term IS NOT NULL), mt AS (SELECT *, CASE matched_term WHEN 'gear' THEN 1 WHEN 'red' THEN 2 WHEN 'blue' THEN 2 WHEN 'plate' THEN 3 WHEN 'cold' THEN 4 ELSE 5 END AS tier,
  CASE matched_term WHEN 'gear' THEN 'direct_workings' WHEN 'red' THEN 'mining_culture' WHEN 'blue' THEN 'mining_culture' WHEN 'plate' THEN 'ore_and_gangue'
  WHEN 'cold' THEN 'alteration_and_gossan' ELSE 'anti_signal' END AS tier_name FROM matched)"""


@register("place_name_matches", f"""{_MATCH.format(views=with_views('place_name'))} SELECT feature_id, tier, tier_name, matched_term FROM mt""")
def _(spark, d):
    return tp.match_names(view(spark, d, "place_name"), LEX).select("feature_id", "tier", "tier_name", "matched_term")


def _gold_case():
    whens = ["WHEN feature_class = 'Civil' THEN NULL"]
    for tier in (5, 1, 2, 3, 4):
        for t in sorted(fixed.LEXICON_TERMS[tier], key=lambda t: -len(t)):
            land = " AND feature_class IN ('Summit', 'Ridge')" if tier == 4 else ""
            whens.append(f"WHEN regexp_matches(name, '(?i)\\b{t}\\b'){land} THEN {tier}")
    return "CASE " + " ".join(whens) + " END"


@register("place_name_gold_lexicon", f"""{with_views('place_name')}, named AS (SELECT feature_id, feature_class, name || CASE feature_id % 6
  WHEN 0 THEN ' Mine' WHEN 1 THEN ' Mill Creek' WHEN 2 THEN ' Golden Ridge' WHEN 3 THEN ' Prospect Point' WHEN 4 THEN ' rusty lime' ELSE '' END AS name FROM place_name)
  SELECT * FROM (SELECT feature_id, {_gold_case()} AS tier FROM named) WHERE tier IS NOT NULL""")
def _(spark, d):
    tail = F.element_at(F.array(*[F.lit(t) for t in (" Mine", " Mill Creek", " Golden Ridge", " Prospect Point", " rusty lime", "")]),
                        (F.col("feature_id") % 6 + 1).cast("int"))
    names = view(spark, d, "place_name").withColumn("name", F.concat("name", tail))
    lex = Lexicon(landforms=("Summit", "Ridge"), excluded=("Civil",))
    return tp.match_names(names, lex).select("feature_id", "tier")


_SAMP = f"""smp AS (SELECT feature_id, steps, unnest(range(0, steps + 1)) AS i, lon, lat, source_lon, source_lat FROM (SELECT *,
  CASE WHEN source_lon IS NULL OR len < 1e-6 THEN 0 ELSE greatest(2, least(60, CAST(floor(len * 111000 / 500) AS INT))) END AS steps
  FROM (SELECT *, sqrt(pow(source_lon - lon, 2) + pow(source_lat - lat, 2)) AS len FROM place_name))),
  pts AS (SELECT feature_id, i, CASE WHEN steps = 0 THEN lon ELSE lon + (source_lon - lon) * i / steps END AS slon,
  CASE WHEN steps = 0 THEN lat ELSE lat + (source_lat - lat) * i / steps END AS slat FROM smp)"""


@register("stream_samples", f"""{with_views('place_name')}, {_SAMP} SELECT feature_id, {q.rd('slon', 6)} AS slon, {q.rd('slat', 6)} AS slat FROM pts""")
def _(spark, d):
    return tp.extent_samples(view(spark, d, "place_name")).select(
        "feature_id", round_dp(F.col("slon"), 6).alias("slon"), round_dp(F.col("slat"), 6).alias("slat"))


_REACH = f"""{_MATCH.format(views=with_views('aoi', 'occurrence', 'place_name'))}, {_SAMP}, {q.square_aoi()}, {q.cover_ctes(4000)},
  cb AS (SELECT aoi_id, col, row, least(lon0,lon1,lon2,lon3) AS w, greatest(lon0,lon1,lon2,lon3) AS e, least(lat0,lat1,lat2,lat3) AS s, greatest(lat0,lat1,lat2,lat3) AS n
    FROM (SELECT aoi_id, col, row, {q.corners('col', 'row', '4000')} FROM cells)),
  cc AS (SELECT *, (w + e) / 2 AS clon, (s + n) / 2 AS clat, 1.5e0 * greatest({q.km('w', '(s + n) / 2', 'e', '(s + n) / 2')}, {q.km('(w + e) / 2', 's', '(w + e) / 2', 'n')}) / 2 AS reach FROM cb),
  rch AS (SELECT aoi_id, col, row, feature_id, min(km) AS km FROM (SELECT aoi_id, col, row, reach, feature_id, {q.km('clon', 'clat', 'slon', 'slat')} AS km
    FROM cc JOIN pts ON slat BETWEEN s - 0.05 AND n + 0.05 AND slon BETWEEN w - 0.08 AND e + 0.08) WHERE km <= reach GROUP BY 1, 2, 3, 4),
  oc0 AS (SELECT m.feature_id, {q.km('m.lon', 'm.lat', 'o.lon', 'o.lat')} AS km, o.name FROM mt m, occurrence o),
  oc AS (SELECT feature_id, min(km) AS okm, arg_min(name, km) AS oname FROM oc0 GROUP BY 1),
  hits AS (SELECT r.aoi_id, r.col, r.row, m.*, {q.rd('r.km', 2)} AS distance_km, {q.rd('okm', 2)} AS okm2, oname,
    CASE WHEN okm <= 1.5 THEN 'corroborated' WHEN okm >= 5 THEN 'uncorroborated' ELSE 'unknown' END AS corroboration FROM rch r JOIN mt m USING (feature_id) JOIN oc USING (feature_id))"""


def reach_hits(spark, d, cells=None):
    """Names in reach of cells of the grid, and those that mean something: the same for every area that has the cell."""
    names, cells = view(spark, d, "place_name"), (outline_cells(spark, d) if cells is None else cells).select(*spatial.SQUARE).distinct()
    reach = materialise(tp.names_in_reach(cells, names, spatial.SQUARE, 4000), "reach")
    matched = tp.match_names(names, LEX)
    return reach, tp.cell_hits(reach, matched, tp.corroborate(matched, view(spark, d, "occurrence")))


@register("cell_toponyms", f"""{_REACH}, tot AS (SELECT aoi_id, col, row, count(*) AS named FROM rch GROUP BY 1, 2, 3),
  g AS (SELECT aoi_id, col, row, count(*) FILTER (tier <> 5) AS hits, count(*) FILTER (tier = 5) AS suppressed, count(*) FILTER (tier IN (1, 2)) AS st,
  count(*) FILTER (tier IN (3, 4)) AS wk, count(DISTINCT name) FILTER (tier IN (1, 2)) AS dn, coalesce(bool_or(tier <> 5 AND corroboration = 'corroborated'), false) AS kn FROM hits GROUP BY 1, 2, 3)
  SELECT aoi_id, col, row, hits, suppressed, named AS named_features_nearby, {q.rd('hits / named')} AS hit_density,
  CASE WHEN hits = 0 OR kn THEN 0e0 ELSE {q.rd('least(0.6e0, CASE WHEN st > 0 THEN 0.45e0 WHEN wk > 0 THEN 0.3e0 ELSE 0e0 END + CASE WHEN dn >= 3 THEN 0.1e0 ELSE 0e0 END)')} END AS score_cap
  FROM g JOIN tot USING (aoi_id, col, row)""")
def _(spark, d):
    reach, hits = reach_hits(spark, d)
    return of_all_cells(spark, d, tp.cell_summary(hits, reach, spatial.SQUARE))


@register("cell_toponym_sentences", f"""{_REACH} SELECT aoi_id, col, row, place, 'Toponym: "' || name || '" (GNIS ' || feature_class || ', Tier ' || tier || ' ' ||
  replace(tier_name, '_', ' ') || '; matched "' || matched_term || '") ' || printf('%.1f', {q.rd('distance_km', 1)}) || ' km from cell centre. ' ||
  CASE corroboration WHEN 'corroborated' THEN 'Recorded occurrence ''' || oname || ''' ' || printf('%.1f', {q.rd('okm2', 1)}) || ' km away — corroborated.'
  WHEN 'uncorroborated' THEN 'No recorded occurrence within 5 km — uncorroborated.' ELSE 'Occurrence data unavailable — corroboration unknown.' END AS sentence
  FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, col, row ORDER BY tier, distance_km, feature_id) AS place FROM hits WHERE tier <> 5) WHERE place <= 3""")
def _(spark, d):
    _, hits = reach_hits(spark, d)
    rows = tp.top_hits(hits, spatial.SQUARE).select(*spatial.SQUARE, "place", tp.evidence_sentence().alias("sentence"))
    return of_all_cells(spark, d, rows)


# --- lines: three-vertex traces at the occurrences, every fourth kind a point ---------------------
_LN = """SELECT site_id AS line_id, CASE site_id % 4 WHEN 0 THEN 'fault' WHEN 1 THEN 'fold' WHEN 2 THEN 'fault' ELSE 'vent' END AS kind,
  CASE WHEN site_id % 3 = 0 THEN name END AS name, lon, lat, CASE WHEN site_id % 4 = 3 THEN 0e0 ELSE ((site_id * 31) % 61 - 30) / 25e1 END AS dx,
  CASE WHEN site_id % 4 = 3 THEN 0e0 ELSE ((site_id * 17) % 53 - 20) / 25e1 END AS dy FROM occurrence"""


def lines(spark, d):
    df = view(spark, d, "occurrence").selectExpr(
        "site_id AS line_id", "CASE site_id % 4 WHEN 0 THEN 'fault' WHEN 1 THEN 'fold' WHEN 2 THEN 'fault' ELSE 'vent' END AS kind",
        "CASE WHEN site_id % 3 = 0 THEN name END AS name", "lon", "lat",
        "CASE WHEN site_id % 4 = 3 THEN 0e0 ELSE ((site_id * 31) % 61 - 30) / 25e1 END AS dx",
        "CASE WHEN site_id % 4 = 3 THEN 0e0 ELSE ((site_id * 17) % 53 - 20) / 25e1 END AS dy")
    v = lambda x, y: f"struct({x} AS x, {y} AS y)"
    one, two, three = v("lon", "lat"), v("lon + dx", "lat + dy"), v("lon + dx + dy", "lat + dy * 2")
    return df.selectExpr("line_id", "kind", "name", f"CASE WHEN kind = 'vent' THEN array(array({one})) ELSE array(array({one}, {two}, {three})) END AS parts")


def segments(spark, d):
    return ln.line_segments(lines(spark, d), ["line_id", "kind", "name"])


_SEG = f"""ln AS ({_LN}), seg AS (SELECT line_id, kind, name, lon AS ax, lat AS ay, lon + dx AS bx, lat + dy AS by FROM ln UNION ALL
  SELECT line_id, kind, name, lon + dx, lat + dy, lon + dx + dy, lat + dy * 2 FROM ln WHERE kind <> 'vent')"""
_TRD = f"""tr AS (SELECT line_id, kind, {q.albers_x('lon', 'lat')} AS x0, {q.albers_y('lon', 'lat')} AS y0, {q.albers_x('lon + dx', 'lat + dy')} AS x1, {q.albers_y('lon + dx', 'lat + dy')} AS y1,
  {q.albers_x('lon + dx + dy', 'lat + dy * 2')} AS x2, {q.albers_y('lon + dx + dy', 'lat + dy * 2')} AS y2 FROM ln), tr2 AS (SELECT line_id, kind,
  CASE WHEN x2 <> x0 OR y2 <> y0 THEN (degrees(atan2(x2 - x0, y2 - y0)) + 360) % 180 END AS azimuth_deg,
  floor(sqrt(pow(x1-x0,2)+pow(y1-y0,2)) * 1e3 + 0.5) / 1e3 + floor(sqrt(pow(x2-x1,2)+pow(y2-y1,2)) * 1e3 + 0.5) / 1e3 AS length_m FROM tr)"""


@register("line_trend_length", f"""{with_views('occurrence')}, {_SEG}, {_TRD} SELECT line_id, {q.rd('azimuth_deg', 3)} AS azimuth_deg, {q.rd('length_m', 3)} AS length_m,
  coalesce(azimuth_deg <= 30 OR azimuth_deg >= 165, false) AS favourable FROM tr2""")
def _(spark, d):
    from lodegrid.functions.scalars import favourable_trend
    return ln.trend_and_length(segments(spark, d), ["line_id"]).select(
        "line_id", round_dp(F.col("azimuth_deg"), 3).alias("azimuth_deg"), round_dp(F.col("length_m"), 3).alias("length_m"),
        favourable_trend(F.col("azimuth_deg")).alias("favourable"))


@register("azimuth_histogram", f"""{with_views('occurrence')}, {_SEG}, {_TRD} SELECT CAST(floor(azimuth_deg / 15) * 15 AS INT) AS bin, count(*) AS lines,
  count(*) FILTER (azimuth_deg <= 30 OR azimuth_deg >= 165) AS favourable FROM tr2 WHERE azimuth_deg IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return ln.azimuth_histogram(ln.trend_and_length(segments(spark, d), ["line_id"]))


def _cross(a, b, p):
    return f"(({b[0]} - {a[0]}) * ({p[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({p[0]} - {a[0]}))"


def _touch(a, b, c, e):
    o1, o2, o3, o4 = _cross(a, b, c), _cross(a, b, e), _cross(c, e, a), _cross(c, e, b)
    def on(p, r, s):
        return f"({s[0]} BETWEEN least({p[0]}, {r[0]}) AND greatest({p[0]}, {r[0]}) AND {s[1]} BETWEEN least({p[1]}, {r[1]}) AND greatest({p[1]}, {r[1]}))"
    return (f"((sign({o1}) * sign({o2}) < 0 AND sign({o3}) * sign({o4}) < 0) OR ({o1} = 0 AND {on(a, b, c)}) OR ({o2} = 0 AND {on(a, b, e)}) "
            f"OR ({o3} = 0 AND {on(c, e, a)}) OR ({o4} = 0 AND {on(c, e, b)}))")


def _seg_quad():
    a, b = ("la_x", "la_y"), ("lb_x", "lb_y")
    sides = [((f"px{i}", f"py{i}"), (f"px{(i+1)%4}", f"py{(i+1)%4}")) for i in range(4)]
    inside = " AND ".join(f"{_cross(c, e, a)} >= 0" for c, e in sides)
    touch = " OR ".join(_touch(a, b, c, e) for c, e in sides)
    ds = [q.seg_d2(*p, *c, *e) for c, e in sides for p in (a, b)] + [q.seg_d2(*c, *a, *b) for c, _ in sides]
    return f"CASE WHEN ({inside}) OR {touch} THEN 0e0 ELSE sqrt(least({', '.join(ds)})) END"


def near_lines_sql(radius, seg="seg", keep="line_id, kind, name"):
    pad = radius / 70000
    return f"""nl AS (SELECT aoi_id, col, row, {keep}, min(dm) AS dm FROM (SELECT *, {_seg_quad()} AS dm FROM (
      SELECT f.*, s.*, (s.ax - lon00) * mx AS la_x, (s.ay - lat00) * 110574e0 AS la_y, (s.bx - lon00) * mx AS lb_x, (s.by - lat00) * 110574e0 AS lb_y
      FROM framed f JOIN {seg} s ON greatest(s.ay, s.by) >= least(lat0, lat1) - {pad} AND least(s.ay, s.by) <= greatest(lat2, lat3) + {pad}
      AND greatest(s.ax, s.bx) >= least(lon0, lon3) - {pad} AND least(s.ax, s.bx) <= greatest(lon1, lon2) + {pad})) WHERE dm <= {radius} GROUP BY ALL)"""


_NL = f"""{with_views('aoi', 'occurrence')}, {q.square_aoi()}, {q.cover_ctes(4000)}, {q.framed_ctes(4000)}, {_SEG}, {_TRD}, {near_lines_sql(6000)}"""


def line_facts(spark, d):
    return ln.trend_and_length(segments(spark, d), ["line_id", "kind", "name"])


def structures(spark, d, crossings=False, beyond=True, cells=None):
    """Structure facts of the cells of every outline, or of framed ``cells``."""
    cells, segs = framed(spark, d) if cells is None else cells, segments(spark, d)
    near = materialise(ln.lines_near_squares(cells, segs, "line_id", fixed.STRUCTURE_BUFFER_M, 4000, "kind", beyond), "lines")
    met = ln.fault_crossings_all(near, segs, spatial.SQUARE) if crossings else None
    return ln.shared_structure_facts(cells, near.drop("kind"), segs, line_facts(spark, d), KEYS, met)


def faults_in_squares(spark, d):
    """Faults that meet cells of the grid: the same for every area that has the cell."""
    cells = spatial.squares(framed(spark, d))
    return ln.cells_near_segments(cells, segments(spark, d).where("kind = 'fault'"), 0.0, 4000, spatial.SQUARE, ["line_id", "kind"], side=2.0)


def of_all_cells(spark, d, rows):
    """Rows of cells of the grid for every area that has the cell."""
    return aoi_cells(spark, d).join(shuffled(rows), spatial.SQUARE).drop("res").select(*KEYS, *[c for c in rows.columns if c not in spatial.SQUARE])


@register("cell_structures", f"""{_NL}, nz AS (SELECT nl.*, {q.rd('azimuth_deg', 1)} AS az FROM nl JOIN tr2 USING (line_id)), cl AS (SELECT * FROM nz WHERE dm <= 1700),
  k AS (SELECT aoi_id, col, row, kind, count(*) AS n, {q.rd('min(dm) / 1000', 2)} AS km FROM cl GROUP BY 1, 2, 3, 4),
  k2 AS (SELECT aoi_id, col, row, CAST(sum(n) AS BIGINT) AS cnt, string_agg(kind || ' ' || n || ' ' || km, '|' ORDER BY kind) AS kinds FROM k GROUP BY 1, 2, 3),
  t AS (SELECT aoi_id, col, row, array_to_string(list_sort(list(DISTINCT az))[1:8], '|') AS azimuths,
    coalesce(array_to_string(list_sort(list(DISTINCT az) FILTER (az <= 30 OR az >= 165))[1:6], '|'), '') AS fav FROM cl WHERE az IS NOT NULL GROUP BY 1, 2, 3),
  nm AS (SELECT aoi_id, col, row, array_to_string(list(name ORDER BY line_id)[1:4], '|') AS named FROM cl WHERE name IS NOT NULL GROUP BY 1, 2, 3),
  fx AS (SELECT f.* FROM framed f ANTI JOIN nl USING (aoi_id, col, row)),
  fl AS (SELECT aoi_id, col, row, line_id, kind, min(dm) AS dm FROM (SELECT *, {_seg_quad()} AS dm FROM (
    SELECT f.*, s.*, (s.ax - lon00) * mx AS la_x, (s.ay - lat00) * 110574e0 AS la_y, (s.bx - lon00) * mx AS lb_x, (s.by - lat00) * 110574e0 AS lb_y FROM fx f, seg s)) GROUP BY ALL),
  ne AS (SELECT aoi_id, col, row, kind AS nearest_kind, {q.rd('dm / 1000', 2)} AS nearest_km FROM (
    SELECT aoi_id, col, row, line_id, kind, dm FROM nz UNION ALL SELECT aoi_id, col, row, line_id, kind, dm FROM fl) QUALIFY row_number() OVER (PARTITION BY aoi_id, col, row ORDER BY dm, line_id) = 1)
  SELECT c.*, coalesce(cnt, 0) AS count, kinds, azimuths, fav AS favourable_azimuths, CASE WHEN cnt > 0 THEN coalesce(fav <> '', false) END AS favourable_trend, named, nearest_km, nearest_kind
  FROM cells c LEFT JOIN k2 USING (aoi_id, col, row) LEFT JOIN t USING (aoi_id, col, row) LEFT JOIN nm USING (aoi_id, col, row) LEFT JOIN ne USING (aoi_id, col, row)""")
def structure_rows(spark, d):
    out = structures(spark, d)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    kinds = F.array_join(F.transform("kinds", lambda k: F.concat_ws(" ", k["kind"], k["n"].cast("string"), k["km"].cast("string"))), "|")
    return of_all_areas(spark, d, out.select(*KEYS, "count", kinds.alias("kinds"), text("azimuths"), text("favourable_azimuths"), "favourable_trend", text("named"),
                                             "nearest_km", "nearest_kind"))


@register("cell_fault_crossings", f"""{_NL}, ins AS (SELECT DISTINCT aoi_id, col, row, line_id FROM nl WHERE kind = 'fault' AND dm = 0),
  pr AS (SELECT a.aoi_id, a.col, a.row, a.line_id AS la, b.line_id AS lb FROM ins a JOIN ins b ON a.aoi_id = b.aoi_id AND a.col = b.col AND a.row = b.row AND a.line_id < b.line_id),
  cr AS (SELECT DISTINCT la, lb FROM (SELECT DISTINCT la, lb FROM pr) JOIN seg p ON p.line_id = la JOIN seg s ON s.line_id = lb
    WHERE {_touch(('p.ax', 'p.ay'), ('p.bx', 'p.by'), ('s.ax', 's.ay'), ('s.bx', 's.by'))})
  SELECT aoi_id, col, row, count(*) AS fault_intersections_in_cell FROM pr JOIN cr USING (la, lb) GROUP BY 1, 2, 3""")
def _(spark, d):
    return of_all_cells(spark, d, ln.fault_crossings_all(faults_in_squares(spark, d), segments(spark, d), spatial.SQUARE))


_DIST = f"""{with_views('aoi', 'place_name')}, {q.square_aoi()}, {q.cover_ctes(4000)}, {q.framed_ctes(4000)}, {overlay_sql(4000)},
  pdeg AS ({{edges}}), {near_lines_sql(2000, 'pdeg', 'feature_id')}"""


def _deg_edges():
    from lodegrid.catalog.geometry import _outline, POLY_SIZE
    sel = []
    for ps in _outline("lon", "lat", POLY_SIZE):
        for i, (x, y) in enumerate(ps):
            x2, y2 = ps[(i + 1) % len(ps)]
            sel.append(f"SELECT feature_id, {x} AS ax, {y} AS ay, {x2} AS bx, {y2} AS by FROM place_name")
    return " UNION ALL ".join(sel)


@register("cell_district", f"""{_DIST.format(edges=_deg_edges())}, al AS (SELECT aoi_id, c.col, c.row, feature_id, 0e0 AS dm FROM cells c JOIN frac f USING (col, row) WHERE f.f > 1e-9 OR f.tch
  UNION ALL SELECT aoi_id, col, row, feature_id, dm FROM nl), b AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY aoi_id, col, row ORDER BY dm, feature_id) = 1)
  SELECT c.*, feature_id, {q.rd('dm / 1000', 2)} AS km, dm = 0 AS inside FROM cells c LEFT JOIN b USING (aoi_id, col, row)""")
def cell_district(spark, d):
    return of_all_areas(spark, d, district_rows(spark, d))


def district_rows(spark, d, cells=None):
    """The district of each cell of every outline. A cell that polygons touch has the lowest of them in every frame; borders are
    looked for from the others only."""
    cells = framed(spark, d) if cells is None else cells
    touched = overlay.polygon_cells(polygon_edges(spark, d), ["feature_id"], 4000)
    touched = materialise(touched.groupBy(*spatial.SQUARE).agg(F.min("feature_id").alias("feature_id")), "touched")
    covered = cells.select(*dict.fromkeys([*KEYS, *spatial.SQUARE])).join(shuffled(touched), spatial.SQUARE)
    bare = materialise(cells.join(shuffled(touched), spatial.SQUARE, "left_anti"), "bare")
    borders = ln.line_segments(polygons(spark, d).withColumnRenamed("rings", "parts"), ["feature_id"])
    listed = ln.lines_near_squares(bare, borders, "feature_id", 2000.0, 4000, beyond=False)
    least = listed.groupBy(*spatial.SQUARE).agg(F.min("high_m").alias("_least"))
    listed = listed.join(shuffled(least), spatial.SQUARE).where("low_m <= _least")
    near = ln.measured_lines(bare, listed, borders, "feature_id", KEYS).where("distance_m <= 2000.0")
    return ln.polygon_of_cell(cells, covered, near, KEYS, "feature_id")


@register("cell_favourable_trend", f"""{with_views('aoi', 'occurrence', 'place_name')}, {q.square_aoi()}, {q.cover_ctes(4000)}, {q.framed_ctes(4000)}, {_SEG}, {_TRD}, {near_lines_sql(1700)},
  {overlay_sql(4000)}, mp AS (SELECT DISTINCT col, row FROM frac WHERE f > 1e-9 OR tch), fv AS (SELECT aoi_id, col, row, bool_or(azimuth_deg <= 30 OR azimuth_deg >= 165) AS ok FROM nl JOIN tr2 USING (line_id) GROUP BY 1, 2, 3)
  SELECT c.*, CASE WHEN mp.col IS NOT NULL THEN coalesce(ok, false) END AS favourable_trend FROM cells c LEFT JOIN mp USING (col, row) LEFT JOIN fv USING (aoi_id, col, row)""")
def _(spark, d):
    units = overlay.polygon_cells(polygon_edges(spark, d), ["feature_id"], 4000).select(*spatial.SQUARE).distinct()
    mapped = outline_cells(spark, d).join(shuffled(units), spatial.SQUARE, "left_semi")
    return of_all_areas(spark, d, ln.trend_by_cell(mapped, structures(spark, d, beyond=False), KEYS))


@register("longest_structures", f"""{with_views('occurrence')}, {_SEG}, {_TRD} SELECT line_id, {q.rd('coalesce(length_m, 0) / 1000', 2)} AS length_km FROM tr2 ORDER BY length_km DESC, line_id LIMIT 60""")
def _(spark, d):
    rows = lines(spark, d).select("line_id", "kind", "name").join(shuffled(ln.trend_and_length(segments(spark, d), ["line_id"])), "line_id")
    return ln.longest_structures(rows).select("line_id", "length_km")


@register("line_bounds", f"""{with_views('occurrence')}, {_SEG} SELECT line_id, min(least(ax, bx)) AS min_lon, max(greatest(ay, seg.by)) AS max_lat, CAST(floor(min(least(ax, bx))) AS INT) AS tile_lon FROM seg GROUP BY 1""")
def _(spark, d):
    from lodegrid.sinks.tables import with_bounds
    return with_bounds(segments(spark, d), ["line_id"]).select("line_id", "min_lon", "max_lat", "tile_lon")
