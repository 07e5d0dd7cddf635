"""Raster and weights-of-evidence queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.catalog import sqlmath as q
from lodegrid.catalog.registry import register
from lodegrid.catalog.views import view, with_views
from lodegrid.functions import grid as g
from lodegrid.functions.scalars import round_dp
from lodegrid.operators import raster, wofe

_V = with_views("wofe_cell")
_C = "CASE {u} " + " ".join(f"WHEN '{k}' THEN {v[0]}e0" for k, v in fixed.CONTRASTS.items()) + " END"


def _c(u):
    return _C.format(u=u)


_BUF = f"""{_V}, buf AS (SELECT c.col, c.row, max({_c('n.geol_unit')}) AS bc FROM wofe_cell c JOIN wofe_cell n
  ON n.col BETWEEN c.col - 1 AND c.col + 1 AND n.row BETWEEN c.row - 1 AND c.row + 1 AND NOT (n.col = c.col AND n.row = c.row)
  GROUP BY 1, 2), flt AS (SELECT c.col, c.row, min(pow(c.col - f.col, 2) + pow(c.row - f.row, 2)) AS d2
  FROM wofe_cell c JOIN wofe_cell f ON f.fault_code IS NOT NULL AND abs(f.col - c.col) <= 16 AND abs(f.row - c.row) <= 16 GROUP BY 1, 2)"""
_TERMS = f"""{_BUF}, t0 AS (SELECT c.*, {_c('c.geol_unit')} AS own, bc, CASE WHEN d2 <= 256 THEN sqrt(d2) * 250e0 END AS fd
  FROM wofe_cell c LEFT JOIN buf USING (col, row) LEFT JOIN flt USING (col, row)), terms AS (SELECT *,
  greatest(coalesce(own, 0e0), coalesce(bc, 0e0)) AS contrast, coalesce(fd <= 1700, false) AS inbuf,
  own IS NULL AND bc IS NOT NULL AS bufonly, CASE WHEN own IS NOT NULL THEN geol_unit_frac ELSE 0e0 END AS favfrac FROM t0)"""
_UNIT_OF = "CASE contrast " + " ".join(f"WHEN {v[0]}e0 THEN '{k}'" for k, v in fixed.CONTRASTS.items()) + " END"
_NATIVE = f"""{_TERMS}, pr AS (SELECT ln((50e0 / greatest(count(*), 51)) / (1 - 50e0 / greatest(count(*), 51))) AS prior FROM wofe_cell),
  nat0 AS (SELECT *, CASE WHEN contrast > 0 AND inbuf THEN 'favourable' WHEN contrast > 0 THEN 'permissive' ELSE 'non_permissive' END AS tract,
  prior + contrast + CASE WHEN inbuf THEN 1e0 ELSE 0e0 END AS logit,
  0.75e0 * least(1e0, (contrast + CASE WHEN inbuf THEN 1e0 ELSE 0e0 END) / 5.55e0) + 0.15e0 * coalesce(greatest(0e0, 1 - fd / 4000e0), 0e0) AS base
  FROM terms, pr), nat AS (SELECT *, 1 / (1 + exp(-logit)) AS posterior, {q.rd('''CASE tract WHEN 'favourable' THEN 0.7e0 + base / 0.9e0 * (0.95e0 - 0.7e0)
  WHEN 'permissive' THEN 0.35e0 + base / 0.9e0 * (0.65e0 - 0.35e0) ELSE base / 0.9e0 * 0.3e0 END''')} AS score FROM nat0)"""


def native(spark, d):
    return wofe.native_scores(view(spark, d, "wofe_cell"))


@register("wofe_code_descriptions", f"""{_V} SELECT col, row, CASE fault_code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in fixed.FAULT_TYPES.items())} END AS fault_type,
  CASE fold_code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in fixed.FOLD_TYPES.items())} END AS fold_type,
  coalesce(fault_code IN (43, 44, 45), false) AS predictor_fault FROM wofe_cell""")
def _(spark, d):
    return wofe.describe_codes(view(spark, d, "wofe_cell")).select("col", "row", "fault_type", "fold_type", "predictor_fault")


@register("wofe_lithology_buffer", f"{_BUF} SELECT col, row, bc AS contrast FROM buf WHERE bc IS NOT NULL")
def _(spark, d):
    cells = view(spark, d, "wofe_cell")
    out = wofe.buffered_unit(cells).join(cells.select("col", "row"), ["col", "row"], "left_semi")
    return out.select("col", "row", wofe.contrast(F.col("buffer_unit")).alias("contrast"))


@register("wofe_fault_distance", f"""{_BUF} SELECT col, row, {q.rd('sqrt(d2) * 250e0', 3)} AS fault_distance_m FROM flt WHERE d2 <= 256""")
def _(spark, d):
    cells = view(spark, d, "wofe_cell")
    out = wofe.fault_distance(cells).join(cells.select("col", "row"), ["col", "row"], "left_semi")
    return out.withColumn("fault_distance_m", round_dp(F.col("fault_distance_m"), 3))


@register("wofe_native_scores", f"""{_NATIVE} SELECT col, row, score, tract, {q.rd('posterior', 8)} AS posterior, {q.rd('logit', 6)} AS logit,
  contrast, {_UNIT_OF} AS wofe_unit, bufonly AS litho_buffer_only, inbuf AS fault_within_buffer, favfrac AS favourable_frac FROM nat""")
def _(spark, d):
    return native(spark, d).select(
        "col", "row", "score", "tract", round_dp(F.col("posterior"), 8).alias("posterior"), round_dp(F.col("logit"), 6).alias("logit"),
        "contrast", "wofe_unit", "litho_buffer_only", "fault_within_buffer", "favourable_frac")


def requests(spark, d):
    """Cell ids at 125, 250, 1000 and 2000 m over and beyond the footprint, with some malformed ones."""
    base = view(spark, d, "wofe_cell").select("col", "row")
    k = F.array(*[F.struct(F.lit(r).alias("res"), F.lit(s).alias("s")) for r, s in ((125, 0.5), (250, 1.0), (1000, 4.0), (2000, 8.0))])
    rung = base.withColumn("k", F.explode(k)).select(
        F.col("k.res").alias("res"), (F.floor((F.col("col") + 3) / F.col("k.s"))).cast("int").alias("col"),
        (F.floor((F.col("row") + 5) / F.col("k.s"))).cast("int").alias("row")).distinct()
    return rung.select(g.cell_id(F.col("res"), F.col("col"), F.col("row")).alias("cell_id"))


_REQ = f"""{_NATIVE}, ks AS (SELECT unnest([{{res: 125, s: 0.5e0}}, {{res: 250, s: 1e0}}, {{res: 1000, s: 4e0}}, {{res: 2000, s: 8e0}}]) AS k),
  req AS (SELECT DISTINCT k.res AS res, CAST(floor((col + 3) / k.s) AS INT) AS rc, CAST(floor((row + 5) / k.s) AS INT) AS rr FROM wofe_cell, ks),
  kid AS (SELECT res, rc, rr, n.* FROM req JOIN nat n ON CASE WHEN res >= 250 THEN n.col // (res // 250) = rc AND n.row // (res // 250) = rr
    ELSE n.col = rc // 2 AND n.row = rr // 2 END),
  roll AS (SELECT res, rc, rr, count(*) AS n, CAST(sum({q.fx('score', 4)}) AS DOUBLE) / 1e4 AS ss, max(score) AS score_max, min(score) AS score_min,
    count(*) FILTER (tract = 'favourable') AS nf, count(*) FILTER (tract = 'permissive') AS np, count(*) FILTER (tract = 'non_permissive') AS nn,
    max(posterior) AS mp, max(logit) AS ml, {q.fsum('favfrac')} AS ff, bool_and(bufonly) FILTER (contrast > 0) AS bo, min(fd) AS fd,
    bool_or(inbuf) AS ib, max(contrast) AS mc FROM kid GROUP BY 1, 2, 3),
  mod0 AS (SELECT res, rc, rr, geol_unit, {q.fsum('geol_unit_frac')} AS a, min(CAST(col AS BIGINT) * 1000000 + row) AS f FROM kid WHERE geol_unit IS NOT NULL GROUP BY 1, 2, 3, 4),
  modal AS (SELECT * FROM mod0 QUALIFY row_number() OVER (PARTITION BY res, rc, rr ORDER BY a DESC, f) = 1),
  res1 AS (SELECT q.res, q.rc, q.rr, coalesce(n, 0) AS n, coalesce(n, 0) / CASE WHEN q.res > 250 THEN pow(q.res // 250, 2) ELSE 1 END AS cov,
    r.* EXCLUDE (res, rc, rr, n), m.geol_unit, m.a FROM req q LEFT JOIN roll r ON r.res = q.res AND r.rc = q.rc AND r.rr = q.rr
    LEFT JOIN modal m ON m.res = q.res AND m.rc = q.rc AND m.rr = q.rr),
  fin AS (SELECT *, CASE WHEN n = 0 THEN 'outside' WHEN cov < 0.5 THEN 'partial' END AS why FROM res1)"""


@register("wofe_rollup", f"""{_REQ} SELECT {q.cell_id('res', 'rc', 'rr')} AS cell_id,
  CASE why WHEN 'outside' THEN '{fixed.REFUSED_OUTSIDE}' WHEN 'partial' THEN '{fixed.REFUSED_PARTIAL}' END AS refused,
  {q.rd('cov', 3)} AS coverage_frac, CASE WHEN why IS NULL THEN {q.rd('ss / n')} END AS score,
  CASE WHEN why IS NULL THEN score_max END AS score_max, CASE WHEN why IS NULL THEN score_min END AS score_min,
  CASE WHEN why IS NULL THEN CASE WHEN nf >= np AND nf >= nn THEN 'favourable' WHEN np >= nn THEN 'permissive' ELSE 'non_permissive' END END AS tract,
  CASE WHEN why IS NULL THEN {q.rd('nf / n', 3)} END AS favourable_share, CASE WHEN why IS NULL THEN {q.rd('mp', 6)} END AS posterior,
  CASE WHEN why IS NULL THEN {q.rd('ml', 4)} END AS logit, CASE WHEN why IS NULL THEN geol_unit END AS unit,
  CASE WHEN why IS NULL THEN {q.rd('a / n', 3)} END AS unit_frac, CASE WHEN why IS NULL THEN {q.rd('mc', 3)} END AS contrast,
  CASE WHEN why IS NULL THEN {q.rd('ff / n', 3)} END AS favourable_frac, CASE WHEN why IS NULL THEN coalesce(bo, false) END AS litho_buffer_only,
  CASE WHEN why IS NULL THEN {q.rd('fd', 1)} END AS fault_distance_m, CASE WHEN why IS NULL THEN ib END AS fault_within_buffer FROM fin""")
def _(spark, d):
    out = wofe.score_requests(requests(spark, d), view(spark, d, "wofe_cell"))
    return out.select(
        "cell_id", "refused", "coverage_frac", "score", "score_max", "score_min", "tract",
        F.col("tract_fracs")["favourable"].alias("favourable_share"), "posterior", "logit", "unit", "unit_frac", "contrast",
        "favourable_frac", "litho_buffer_only", "fault_distance_m", "fault_within_buffer")


@register("wofe_refusals", f"""{_REQ} SELECT res, count(*) AS cells, count(*) FILTER (why IS NULL) AS scored,
  {q.rd('count(*) FILTER (why IS NULL) / count(*)')} AS coverage, count(*) FILTER (why = 'outside') AS refused_outside,
  count(*) FILTER (why = 'partial') AS refused_partial,
  count(*) FILTER (why IS NULL AND nf >= np AND nf >= nn) AS favourable,
  count(*) FILTER (why IS NULL AND NOT (nf >= np AND nf >= nn) AND np >= nn) AS permissive,
  count(*) FILTER (why IS NULL AND NOT (nf >= np AND nf >= nn) AND np < nn) AS non_permissive FROM fin GROUP BY 1""")
def _(spark, d):
    out = wofe.score_requests(requests(spark, d), view(spark, d, "wofe_cell"))
    return wofe.refusal_report(out.withColumn("res", g.parse_cell_id(F.col("cell_id"))["res"]), ["res"])


@register("wofe_evidence_text", f"""{_NATIVE} SELECT col, row, array_to_string([
  CASE WHEN contrast > 0 THEN 'OF-00-495 unit ' || {_UNIT_OF} || ' (' || CASE {_UNIT_OF} {' '.join(f"WHEN '{k}' THEN '" + v[3].replace("'", "''") + "'" for k, v in fixed.CONTRASTS.items())} END || ') ' ||
    CASE WHEN bufonly THEN 'within the 150 m lithologic buffer (adjacent 250 m cell); no favourable unit in the cell itself'
    WHEN own >= coalesce(bc, 0e0) THEN 'mapped in the cell (' || CAST(floor(geol_unit_frac * 100 + 0.5e0) AS BIGINT) || '% of it)'
    ELSE 'in the 150 m buffer; the cell itself holds ' || geol_unit END || '; OF01-501 contrast ' || contrast || ' from ' ||
    CASE {_UNIT_OF} {' '.join(f"WHEN '{k}' THEN {v[1]}" for k, v in fixed.CONTRASTS.items())} END || ' of 50 training sites'
  WHEN geol_unit IS NOT NULL THEN 'OF-00-495 unit ' || geol_unit || ' — zero training sites in OF01-501, ranked ''Outside'''
  ELSE 'No OF-00-495 lithology label in this cell (nodata)' END,
  CASE WHEN fd IS NULL THEN 'No OF-00-495 mapped fault within 4000 m (published optimum buffer 1700 m)'
  ELSE 'Nearest OF-00-495 mapped fault ' || CAST(floor(fd + 0.5e0) AS BIGINT) || CASE WHEN inbuf THEN
    ' m — inside the published 1700 m optimum buffer (its contrast is ASSUMED 1.0, not published)' ELSE ' m — outside the published 1700 m optimum buffer' END END,
  'Fault azimuth unknown: the OF-00-495 raster carries no orientation and the 1:24k geology does not map this cell, so the published 345°-030° trend filter could not be applied',
  'Tract: ' || tract || ' (published score guidance ' || CASE tract WHEN 'favourable' THEN '0.70-0.95' WHEN 'permissive' THEN '0.35-0.65' ELSE '0.00-0.30' END ||
  '); posterior ' || printf('%.2e', posterior) || ' — reported for transparency only, the published posteriors are not reproducible from this raster'], '|') AS evidence FROM nat""")
def _(spark, d):
    cells = view(spark, d, "wofe_cell")
    ids = cells.select(g.cell_id(F.lit(250), F.col("col"), F.col("row")).alias("cell_id"))
    out = wofe.score_requests(ids, cells).withColumn("p", g.parse_cell_id(F.col("cell_id")))
    return out.select("p.col", "p.row", F.array_join("evidence", "|").alias("evidence"))


_AREQ = f"""{_V}, kid AS (SELECT col // 4 AS rc, row // 4 AS rr, * FROM wofe_cell),
  bu AS (SELECT rc, rr, geol_unit, {q.fsum('geol_unit_frac')} AS sh, min(CAST(col AS BIGINT) * 1000000 + row) AS f FROM kid WHERE geol_unit IS NOT NULL GROUP BY 1, 2, 3),
  tot AS (SELECT rc, rr, {q.fsum('sh')} AS total, {q.fsum('CASE WHEN ' + _c('geol_unit') + ' IS NOT NULL THEN sh END')} AS fav,
    arg_max(geol_unit, {_c('geol_unit')}) AS favourable_unit, max({_c('geol_unit')}) AS favourable_contrast FROM bu GROUP BY 1, 2),
  rk AS (SELECT bu.*, total, row_number() OVER (PARTITION BY rc, rr ORDER BY sh DESC, f) AS place FROM bu JOIN tot USING (rc, rr)),
  un AS (SELECT rc, rr, string_agg(geol_unit || ' ' || {q.rd('sh / total', 3)}, '|' ORDER BY place) AS units FROM rk WHERE place <= 4 GROUP BY 1, 2),
  co AS (SELECT rc, rr, count(*) AS source_cells, array_to_string(list_sort(list(DISTINCT fault_code) FILTER (fault_code IS NOT NULL))[1:6], ',') AS fault_codes,
    coalesce(bool_or(fault_code IN (43, 44, 45)), false) AS has_predictor_fault,
    array_to_string(list_sort(list(DISTINCT fold_code) FILTER (fold_code IS NOT NULL))[1:6], ',') AS fold_codes,
    array_to_string(list_sort(list(DISTINCT dike_unit) FILTER (dike_unit IS NOT NULL))[1:4], ',') AS dike_units FROM kid GROUP BY 1, 2)"""


@register("wofe_unit_facts", f"""{_AREQ} SELECT rc AS col, rr AS row, source_cells, units, favourable_unit, favourable_contrast,
  {q.rd('fav / total', 3)} AS favourable_frac, coalesce(fault_codes, '') AS fault_codes, has_predictor_fault, coalesce(fold_codes, '') AS fold_codes,
  coalesce(dike_units, '') AS dike_units FROM co LEFT JOIN un USING (rc, rr) LEFT JOIN tot USING (rc, rr)""")
def _(spark, d):
    cells = view(spark, d, "wofe_cell")
    req = cells.select(F.lit(1000).alias("res"), F.floor(F.col("col") / 4).cast("int").alias("col"),
                       F.floor(F.col("row") / 4).cast("int").alias("row")).distinct().withColumns({"c": F.col("col"), "r": F.col("row")})
    out = wofe.unit_facts(req, cells, ["c", "r"])
    text = F.array_join(F.transform("units", lambda u: F.concat(u["unit"], F.lit(" "), u["frac"].cast("string"))), "|")
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select(F.col("c").alias("col"), F.col("r").alias("row"), "source_cells", text.alias("units"), "favourable_unit",
                      "favourable_contrast", "favourable_frac", join("fault_codes"), "has_predictor_fault", join("fold_codes"), join("dike_units"))


@register("wofe_build_report", f"""{_V} SELECT count(*) AS cells, count(geol_unit) AS with_unit, count(fault_code) AS with_fault,
  count(fold_code) AS with_fold, count(dike_unit) AS with_dike FROM wofe_cell""")
def _(spark, d):
    return wofe.build_report(view(spark, d, "wofe_cell"))


@register("wofe_unit_report", f"""{_V} SELECT geol_unit, count(*) AS cells, count(*) * 0.0625e0 AS km2, {_c('geol_unit')} AS contrast
  FROM wofe_cell WHERE geol_unit IS NOT NULL GROUP BY 1 ORDER BY cells DESC, geol_unit LIMIT 12""")
def _(spark, d):
    return wofe.unit_report(view(spark, d, "wofe_cell"))


@register("wofe_prior_logit", f"""{_V} SELECT {q.rd('ln((50e0 / greatest(count(*), 51)) / (1 - 50e0 / greatest(count(*), 51)))', 9)} AS prior FROM wofe_cell""")
def _(spark, d):
    return view(spark, d, "wofe_cell").agg(F.count("*").alias("n")).select(round_dp(wofe.prior_logit(F.col("n")), 9).alias("prior"))


# --- rasters: values 1..50, of which 45 are declared; several codes share a label ----------------
_PX = f"{with_views('pixel')}, vat AS (SELECT v AS value, 'U' || lpad(CAST(v % 14 AS VARCHAR), 2, '0') AS label FROM (SELECT DISTINCT value AS v FROM pixel) WHERE v <= 45)"


def vat(spark, d):
    v = view(spark, d, "pixel").select("value").distinct().where("value <= 45")
    return v.withColumn("label", F.concat(F.lit("U"), F.lpad((F.col("value") % 14).cast("string"), 2, "0")))


_MODAL = """, n AS (SELECT col, row, {g} AS g, count(*) AS n FROM pixel JOIN vat USING (value) GROUP BY 1, 2, 3),
  m AS (SELECT *, sum(n) OVER (PARTITION BY col, row) AS total, row_number() OVER (PARTITION BY col, row ORDER BY n DESC, g) AS k FROM n)"""


@register("raster_modal_label", f"""{_PX}{_MODAL.format(g='label')} SELECT col, row, g AS modal, n AS modal_count, CAST(total AS BIGINT) AS total_count,
  {q.rd('n / total')} AS modal_frac FROM m WHERE k = 1""")
def _(spark, d):
    return raster.modal_value(view(spark, d, "pixel"), vat(spark, d), ["col", "row"])


@register("raster_modal_code", f"""{_PX}{_MODAL.format(g='value')} SELECT col, row, CAST(g AS VARCHAR) AS modal, n AS modal_count,
  CAST(total AS BIGINT) AS total_count, {q.rd('n / total')} AS modal_frac FROM m WHERE k = 1""")
def _(spark, d):
    codes = vat(spark, d).withColumn("label", F.lit(""))
    return raster.modal_value(view(spark, d, "pixel"), codes, ["col", "row"])


def _layer_sql(name: str, what: str, where: str) -> str:
    return (f"{name} AS (SELECT col, row, {what} AS g, count(*) AS n, sum(count(*)) OVER (PARTITION BY col, row) AS t FROM pixel JOIN vat USING (value) WHERE {where} GROUP BY 1, 2, 3 "
            f"QUALIFY row_number() OVER (PARTITION BY col, row ORDER BY count(*) DESC, {what}) = 1)")


@register("raster_wide_cells", f"""{_PX}, {_layer_sql('geol', 'label', 'true')}, {_layer_sql('fault', 'value', 'value < 6')}, {_layer_sql('fold', 'value', 'value % 7 = 0')}, {_layer_sql('dike', 'label', 'value > 40')},
  k AS (SELECT col, row FROM geol UNION SELECT col, row FROM fault UNION SELECT col, row FROM fold UNION SELECT col, row FROM dike)
  SELECT k.col, k.row, geol.g AS geol, {q.rd('1e0 * geol.n / geol.t')} AS geol_frac, CAST(fault.g AS VARCHAR) AS fault, CAST(fold.g AS VARCHAR) AS fold, dike.g AS dike, {q.rd('1e0 * dike.n / dike.t')} AS dike_frac
  FROM k LEFT JOIN geol ON geol.col = k.col AND geol.row = k.row LEFT JOIN fault ON fault.col = k.col AND fault.row = k.row LEFT JOIN fold ON fold.col = k.col AND fold.row = k.row LEFT JOIN dike ON dike.col = k.col AND dike.row = k.row""")
def _(spark, d):
    """All four layers: labelled units and dikes, coded faults and folds."""
    px, attrs = view(spark, d, "pixel"), vat(spark, d)
    coded = lambda where: attrs.where(where).withColumn("label", F.lit(""))
    tables = {"geol": attrs, "fault": coded("value < 6"), "fold": coded("value % 7 = 0"), "dike": attrs.where("value > 40")}
    layers = {name: raster.modal_value(px, t, ["col", "row"]) for name, t in tables.items()}
    return raster.wide_cells(layers, ["col", "row"]).select("col", "row", "geol", "geol_frac", "fault", "fold", "dike", "dike_frac")


@register("raster_pixel_centres", f"""{with_views('pixel')} SELECT DISTINCT col, row, 500000e0 + (col + 0.5e0) * 50e0 AS x, 5400000e0 - (row + 0.5e0) * 50e0 AS y FROM pixel""")
def _(spark, d):
    x, y = raster.pixel_centres(F.lit(500000.0), F.lit(5400000.0), F.lit(50.0), F.lit(50.0), F.col("col"), F.col("row"))
    return view(spark, d, "pixel").select("col", "row").distinct().select("col", "row", x.alias("x"), y.alias("y"))
