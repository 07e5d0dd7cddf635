"""Filters, cache, responses, telemetry, documents and evaluation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.catalog import sqlmath as q
from lodegrid.catalog.registry import register
from lodegrid.catalog.scoring import WEIGHTS, _FUSED, _LAST, _RANKED, cells_ranked, fused_scores, last_scores
from lodegrid.catalog.views import table, view, with_views
from lodegrid.functions import geo, scalars as sc
from lodegrid.operators import describe, evaluation as ev, records, runs, ranking
from lodegrid.session import scratch_path

_O = with_views("occurrence")


# --- filters and scans --------------------------------------------------------------------------
@register("filter_bbox", f"{_O} SELECT site_id FROM occurrence WHERE lon BETWEEN -122 AND -118.5 AND lat BETWEEN 46.5 AND 48")
def _(spark, d):
    return view(spark, d, "occurrence").where(geo.in_bbox(F.col("lon"), F.col("lat"), -122.0, 46.5, -118.5, 48.0)).select("site_id")


@register("filter_box_overlap", f"{_O} SELECT site_id FROM occurrence WHERE lon - 0.3e0 <= -118.5e0 AND lon + 0.3e0 >= -122e0 AND lat - 0.2e0 <= 48e0 AND lat + 0.2e0 >= 46.5e0")
def _(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    own = (lon - 0.3, lat - 0.2, lon + 0.3, lat + 0.2)
    return view(spark, d, "occurrence").where(geo.boxes_overlap(own, (-122.0, 46.5, -118.5, 48.0))).select("site_id")


@register("query_features_page", f"""{_O} SELECT site_id, name FROM occurrence WHERE lon BETWEEN -124e0 AND -117e0 AND lat BETWEEN 45.7e0 AND 48.8e0
  AND lower(commodity_primary) LIKE '%gold%' ORDER BY site_id LIMIT 50 OFFSET 10""")
def _(spark, d):
    out = records.query_features(view(spark, d, "occurrence"), "-124,45.7,-117,48.8", "gold", limit=50, offset=10)
    return out.select("site_id", "name")


@register("filter_commodity", f"{_O} SELECT site_id FROM occurrence WHERE lower(commodity_primary) LIKE '%gold%'")
def _(spark, d):
    return view(spark, d, "occurrence").where(F.lower("commodity_primary").contains("gold")).select("site_id")


@register("feature_by_id", f"{_O} SELECT site_id, name, lon, lat FROM occurrence WHERE site_id = 42")
def _(spark, d):
    return view(spark, d, "occurrence").where("site_id = 42").select("site_id", "name", "lon", "lat")


@register("window_scan", f"{with_views('wofe_cell')} SELECT col, row, geol_unit FROM wofe_cell WHERE col BETWEEN 2260 AND 2300 AND row BETWEEN 1600 AND 1650")
def _(spark, d):
    from lodegrid.sources.tables import window_scan
    return window_scan(view(spark, d, "wofe_cell"), 2260, 2300, 1600, 1650).select("col", "row", "geol_unit")


@register("key_lookup", f"{with_views('wofe_cell')} SELECT col, row, geol_unit FROM wofe_cell WHERE (col, row) IN (SELECT CAST(2240 + c_custkey % 120 AS INT), CAST(1590 + c_custkey // 120 AS INT) FROM customer)")
def _(spark, d):
    from lodegrid.sources.tables import key_lookup
    keys = table(spark, d, "customer").selectExpr("CAST(2240 + c_custkey % 120 AS INT) AS col", "CAST(1590 + floor(c_custkey / 120) AS INT) AS row")
    return key_lookup(view(spark, d, "wofe_cell"), keys, ["col", "row"]).select("col", "row", "geol_unit")


@register("column_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@register("capped_scan", f"{_O} SELECT site_id, (SELECT count(*) FROM occurrence) > 1000 AS truncated FROM occurrence ORDER BY site_id LIMIT 1000")
def _(spark, d):
    return records.capped(view(spark, d, "occurrence"), ["site_id"], 1000).select("site_id", "truncated")


@register("best_occurrences", f"""{_O} SELECT site_id FROM occurrence ORDER BY CASE WHEN production THEN 0 ELSE 1 END, CASE WHEN assays THEN 0 ELSE 1 END,
  CASE accuracy_class WHEN 'survey' THEN 0 WHEN 'topo' THEN 1 WHEN 'derived' THEN 2 WHEN 'variable' THEN 3 WHEN 'district_centroid' THEN 4 ELSE 5 END, name, site_id LIMIT 40""")
def _(spark, d):
    return records.best_occurrences(view(spark, d, "occurrence"), []).select("site_id")


@register("context_routes", f"""SELECT route, count(*) AS n FROM (SELECT unnest(CASE o_orderpriority WHEN '1-URGENT' THEN ['geology_units'] WHEN '2-HIGH' THEN ['geochemical_samples']
  WHEN '3-MEDIUM' THEN ['fault_traces'] WHEN '5-LOW' THEN ['known_deposits', 'historic_mines'] ELSE ['known_deposits'] END) AS route FROM orders) GROUP BY 1""")
def _(spark, d):
    from lodegrid.sources.normalize import context_route
    p = F.col("o_orderpriority")
    ch = F.when(p == "1-URGENT", "Macrostrat").when(p == "2-HIGH", "usgs_ngdb").otherwise("other")
    ft = F.when(p == "3-MEDIUM", "normal fault").otherwise("deposit")
    st = F.when(p == "5-LOW", "Past Producer").otherwise("prospect")
    return table(spark, d, "orders").select(F.explode(context_route(ch, ft, st)).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@register("capped_runs_newest", f"""{with_views('run')} SELECT run_id, aoi_id FROM run WHERE status = 'completed' AND NOT git_dirty""")
def _(spark, d):
    return view(spark, d, "run").where((F.col("status") == "completed") & ~F.col("git_dirty")).select("run_id", "aoi_id")


@register("bucketed_scan_agrees", f"""{_O} SELECT commodity_primary, count(*) AS n, CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second, true AS equal
  FROM occurrence WHERE lon BETWEEN -122 AND -118.5 AND lat BETWEEN 46.5 AND 48 GROUP BY 1""")
def _(spark, d):
    """A layer written by tile and read back tile by tile for a window, beside a full scan of the same window."""
    path, whole = scratch_path(spark, "tiled"), view(spark, d, "occurrence")
    tiled = whole.withColumns({"tile_lon": F.floor("lon").cast("int"), "tile_lat": F.floor("lat").cast("int")})
    tiled.write.partitionBy("tile_lon", "tile_lat").parquet(path)
    box = geo.in_bbox(F.col("lon"), F.col("lat"), -122.0, 46.5, -118.5, 48.0)
    pruned = F.col("tile_lon").between(-122, -119) & F.col("tile_lat").between(46, 48)
    read = spark.read.schema(tiled.schema).parquet(path).where(pruned).where(box)
    same = records.same_rows(read.select("site_id"), whole.where(box).select("site_id"))
    counts = read.groupBy("commodity_primary").agg(F.count("*").alias("n"))
    return counts.withColumns({c: same.select(c).scalar() for c in ("only_first", "only_second", "equal")})


# --- unions and set operations ------------------------------------------------------------------
@register("union_layers", """SELECT kind, count(*) AS n, count(acct) AS with_acct FROM (SELECT 'site' AS kind, c_custkey AS id, c_acctbal AS acct FROM customer
  UNION ALL SELECT 'feature', s_suppkey, NULL FROM supplier) GROUP BY 1""")
def _(spark, d):
    site = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acct"))
    feature = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return records.union_layers({"site": site, "feature": feature}).groupBy("kind").agg(F.count("*").alias("n"), F.count("acct").alias("with_acct"))


@register("union_keys", "SELECT l_orderkey % 64 AS col, l_partkey % 64 AS row FROM lineitem UNION SELECT o_orderkey % 64, o_custkey % 64 FROM orders")
def _(spark, d):
    a = table(spark, d, "lineitem").selectExpr("l_orderkey % 64 AS col", "l_partkey % 64 AS row")
    return a.union(table(spark, d, "orders").selectExpr("o_orderkey % 64 AS col", "o_custkey % 64 AS row")).distinct()


@register("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(
        table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("set_intersection", "SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier)")
def _(spark, d):
    shared = table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "supplier").select("s_suppkey"))
    return shared.agg(F.count("*").alias("shared")).withColumn("disjoint", F.col("shared") == 0)


# --- cache --------------------------------------------------------------------------------------
_CK = f"{_LAST}, c AS (SELECT aoi_id || '/' || cell_key AS cell_id, agent_id, score, confidence, ord1 AS created_at FROM last)"


def cached(spark, d):
    return last_scores(spark, d).select(F.concat_ws("/", "aoi_id", "cell_key").alias("cell_id"), "agent_id", "score", "confidence", F.col("ord1").alias("created_at"))


@register("cache_keys", f"""{_CK} SELECT cell_id, agent_id, sha256(cell_id || chr(1) || agent_id || chr(1) || 'gold' || chr(1) || 'm1' || chr(1) || 'p1' || chr(1) || chr(2) || chr(1) ||
  CAST(created_at AS VARCHAR)) AS cache_key FROM c""")
def _(spark, d):
    rows = cached(spark, d).withColumns({"mineral": F.lit("gold"), "model": F.lit("m1"), "prompt_version": F.lit("p1"),
                                         "knowledge_hash": F.lit(None).cast("string"), "spatial_context_hash": F.col("created_at").cast("string")})
    return rows.select("cell_id", "agent_id", runs.cache_key().alias("cache_key"))


@register("content_hashes", f"""{_LAST} SELECT aoi_id, cell_key, agent_id, sha256('{{"agent":"' || agent_id || '","aoi":' || aoi_id || ',"cell":' || cell_key || ',"note":null}}') AS h FROM last""")
def _(spark, d):
    return last_scores(spark, d).select("aoi_id", "cell_key", "agent_id", runs.content_hash(
        cell=F.col("cell_key"), aoi=F.col("aoi_id"), note=F.lit(None).cast("string"), agent=F.col("agent_id")).alias("h"))


@register("cache_split", f"""{_CK}, k AS (SELECT cell_id || '/' || agent_id AS cache_key, confidence FROM c), w AS (SELECT DISTINCT cell_id || '/' || a AS cache_key FROM c, (SELECT unnest(['AF', 'ZZ']) AS a))
  SELECT w.cache_key, k.confidence IS NOT NULL AS hit FROM w LEFT JOIN (SELECT * FROM k WHERE confidence > 0) k USING (cache_key)""")
def _(spark, d):
    store = cached(spark, d).withColumn("cache_key", F.concat_ws("/", "cell_id", "agent_id")).where("confidence > 0")
    wanted = cached(spark, d).select("cell_id").distinct().withColumn("a", F.explode(F.array(F.lit("AF"), F.lit("ZZ")))).select(
        "cell_id", F.concat_ws("/", "cell_id", "a").alias("cache_key"))
    hits, misses = runs.split_cached(wanted, store)
    return hits.select("cache_key", F.lit(True).alias("hit")).unionByName(misses.select("cache_key", F.lit(False).alias("hit")))


@register("cache_composite", f"""{_CK} SELECT cell_id, CASE WHEN {q.fsum('confidence')} > 0 THEN {q.rd(q.fsum('score * confidence') + ' / ' + q.fsum('confidence'))} ELSE 0e0 END AS score,
  {q.rd(q.fsum('confidence') + ' / count(*)')} AS confidence, count(*) AS agent_count, string_agg(agent_id, ',' ORDER BY agent_id) AS agents, max(created_at) AS scored_at FROM c GROUP BY 1""")
def _(spark, d):
    return runs.cached_composite(cached(spark, d), ["cell_id"]).withColumn("agents", F.array_join("agents", ","))


@register("cache_stats", f"{_CK} SELECT count(*) AS rows, count(DISTINCT cell_id) AS cells, count(DISTINCT agent_id) AS agents FROM c")
def _(spark, d):
    return runs.cache_stats(cached(spark, d))


@register("cache_put", f"""{with_views('agent_score')}, k AS (SELECT aoi_id || '/' || cell_key || '/' || agent_id AS cache_key, score, confidence, ord1, ord2, ord3 FROM agent_score),
  fresh AS (SELECT * FROM k WHERE ord2 > 2 AND confidence > 0 QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY ord1 DESC, ord2 DESC, ord3 DESC) = 1),
  old AS (SELECT * FROM k WHERE ord2 <= 2 QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY ord1 DESC, ord2 DESC, ord3 DESC) = 1)
  SELECT cache_key, score, confidence FROM fresh UNION ALL SELECT cache_key, score, confidence FROM old WHERE cache_key NOT IN (SELECT cache_key FROM fresh)""")
def _(spark, d):
    k = view(spark, d, "agent_score").select(F.concat_ws("/", "aoi_id", "cell_key", "agent_id").alias("cache_key"), "score", "confidence", "ord1", "ord2", "ord3")
    old = records.latest_version(k.where("ord2 <= 2"), ["cache_key"], ["ord1", "ord2", "ord3"])
    return runs.put_scores(old, k.where("ord2 > 2"), ["ord1", "ord2", "ord3"]).select("cache_key", "score", "confidence")


@register("batch_labels", f"""{_FUSED}, p AS (SELECT aoi_id, cell_key, row_number() OVER (PARTITION BY aoi_id ORDER BY cell_key) - 1 AS i FROM fused)
  SELECT aoi_id, cell_key, CAST(i // 50 AS INT) AS batch, 'c' || (i % 50 + 1) AS label FROM p""")
def _(spark, d):
    return runs.batches(fused_scores(spark, d).select("aoi_id", "cell_key"), ["aoi_id"], ["cell_key"])


# --- responses ----------------------------------------------------------------------------------
# Every turn of every conversation as what a model answered: its text, without brackets and fences, is the prose around the
# items and their evidence. By turn: cut off, wordy, a draft before the fenced answer, a second array, objects in the evidence, no answer.
_R = """WITH response AS (SELECT conv_id AS batch, turn, coalesce(text, '') AS raw, translate(coalesce(text, ''), '[]{}`"', '') AS prose, (conv_id + turn) % 6 AS kind FROM conversations)"""


def responses(spark, d):
    r = table(spark, d, "conversations").select(F.col("conv_id").alias("batch"), "turn", F.coalesce("text", F.lit("")).alias("raw"))
    r = r.withColumns({"prose": F.translate("raw", '[]{}`"', ""), "kind": (F.col("batch") + F.col("turn")) % 6})
    label = F.concat(F.lit("c"), (F.col("turn") % 12 + 1).cast("string"))
    deep = F.struct(F.struct(F.struct(F.lit("c2").alias("cell_id"), F.lit(1).alias("score")).alias("b")).alias("a"))
    item = lambda score, evidence: F.to_json(F.struct(label.alias("cell_id"), score.alias("score"), F.lit(1.5).alias("confidence"), evidence.alias("evidence")))
    good, draft = item((F.col("batch") % 10) / 10.0, F.col("prose")), item(F.lit(0.95), F.lit("draft"))
    nested = F.concat(F.regexp_replace(item((F.col("batch") % 10) / 10.0, F.array("prose")), r"\]\}$", ","), F.to_json(deep), F.lit("]}"))
    text = (F.when(F.col("kind") == 0, F.concat("prose", F.lit(" ["), good, F.lit(',{"cell_id":"c9","sco')))
            .when(F.col("kind") == 1, F.concat("prose", F.lit(" ["), good, F.lit("] as asked.")))
            .when(F.col("kind") == 2, F.concat(F.lit("["), draft, F.lit("] then\n```json\n["), good, F.lit("]\n```\n"), "prose"))
            .when(F.col("kind") == 3, F.concat(F.lit("["), good, F.lit("] or rather ["), draft, F.lit("] "), "prose"))
            .when(F.col("kind") == 4, F.concat(F.lit('{"cells": ['), nested, F.lit("]}"))).otherwise(F.col("prose")))
    return r.withColumn("text", text)


@register("parsed_responses", f"""{_R} SELECT batch, turn, 'cell-' || batch || '-' || turn || '-' || (turn % 12 + 1) AS cell_id,
  (batch % 10) / 1e1 AS score, 1e0 AS confidence, prose AS evidence FROM response WHERE kind < 5""")
def _(spark, d):
    r = responses(spark, d)
    items = runs.parse_responses(r, "text", ["batch", "turn"])
    return runs.scored_from_items(items, batch_cells(r), ["batch", "turn"]).select("batch", "turn", "cell_id", "score", "confidence", F.col("evidence")[0].alias("evidence"))


def batch_cells(r):
    n = F.explode(F.sequence(F.lit(1), F.lit(12)))
    return r.select("batch", "turn", n.alias("n")).select(
        "batch", "turn", F.concat(F.lit("c"), F.col("n").cast("string")).alias("label"),
        F.concat_ws("-", F.lit("cell"), "batch", "turn", "n").alias("cell_id"))


@register("response_health", f"""{_R} SELECT batch, turn, 12 AS requested, CASE WHEN kind < 5 THEN 1 ELSE 0 END AS scored,
  CASE WHEN kind < 5 THEN 'partial' ELSE 'failed' END AS parse_status, length(raw) AS response_chars, left(raw, 400) AS preview FROM response""")
def _(spark, d):
    r = responses(spark, d)
    cells = batch_cells(r)
    scored = runs.scored_from_items(runs.parse_responses(r, "text", ["batch", "turn"]), cells, ["batch", "turn"])
    return runs.parse_health(cells, scored, r, "raw", ["batch", "turn"])


# --- telemetry ----------------------------------------------------------------------------------
_COST = q.rd("(input_tokens * 300 + output_tokens * 1500) / 1e8", 6)


@register("usage_by_agent", f"""{with_views('telemetry')} SELECT run_id, agent_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum({q.fx(_COST, 6)}) AS DOUBLE) / 1e6 AS est_cost_usd FROM telemetry GROUP BY 1, 2""")
def _(spark, d):
    return runs.usage_rollup(view(spark, d, "telemetry"), ["run_id", "agent_id"])


@register("usage_with_total", f"""{with_views('telemetry')} SELECT coalesce(agent_id, 'total') AS agent_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM telemetry GROUP BY GROUPING SETS ((agent_id), ())""")
def _(spark, d):
    return runs.usage_with_total(view(spark, d, "telemetry"), "agent_id")


@register("knowledge_grounding", """SELECT DISTINCT event_type AS domain, CASE WHEN event_type = 'click' THEN 'click/gold.md' WHEN event_type IN ('view', 'purchase') THEN event_type || '/default.md' END AS knowledge_file,
  event_type IN ('click', 'view', 'purchase') AS grounded FROM events""")
def _(spark, d):
    agents = table(spark, d, "events").select(F.col("event_type").alias("domain")).distinct()
    files = agents.where("domain IN ('click', 'view', 'purchase')").select("domain", F.when(F.col("domain") == "click", "gold").otherwise("default").alias("name"))
    files = files.unionByName(agents.where("domain = 'click'").select("domain", F.lit("default").alias("name")))
    return runs.ungrounded(agents, files.withColumn("file", F.concat("domain", F.lit("/"), "name", F.lit(".md"))), "Gold").select("domain", "knowledge_file", "grounded")


# --- documents ----------------------------------------------------------------------------------
@register("document_triage", f"""{with_views('doc_page')}, h AS (SELECT doc, count(*) AS pages, CAST(coalesce(sum(length(text)) FILTER (page <= 5), 0) AS BIGINT) AS sample_chars,
  arg_min(left(text, 400), page) FILTER (page <= 5 AND length(text) > 0) AS head FROM doc_page GROUP BY 1)
  SELECT doc, pages, sample_chars, CASE WHEN sample_chars >= 100 THEN 'text-extractable' ELSE 'scanned-needs-ocr' END AS status,
  trim(regexp_replace(coalesce(head, ''), '\\s+', ' ', 'g')) AS excerpt FROM h""")
def _(spark, d):
    return runs.triage(view(spark, d, "doc_page"))


@register("document_full_text", f"""{with_views('doc_page')} SELECT doc, sha256(string_agg(chr(10) || '[PAGE ' || page || ']' || chr(10) || text || chr(10), '' ORDER BY page)) AS h FROM doc_page WHERE length(text) > 0 GROUP BY 1""")
def _(spark, d):
    return runs.full_text(view(spark, d, "doc_page")).select("doc", F.sha2("text", 256).alias("h"))


@register("document_status_counts", f"""{with_views('doc_page')}, h AS (SELECT doc, coalesce(sum(length(text)) FILTER (page <= 5), 0) AS c FROM doc_page GROUP BY 1)
  SELECT CASE WHEN c >= 100 THEN 'text-extractable' ELSE 'scanned-needs-ocr' END AS status, count(*) AS documents FROM h GROUP BY 1""")
def _(spark, d):
    return runs.status_counts(runs.triage(view(spark, d, "doc_page")))


# --- evaluation ---------------------------------------------------------------------------------
_M4 = "CAST(sum(CAST(floor({x} * 1e4 + 0.5e0) AS BIGINT)) AS DOUBLE) / count({x}) / 1e4"
_RUNM = f"""{_FUSED}, mm AS (SELECT aoi_id, count(*) AS cells, CAST(sum({q.fx('score', 4)}) AS DOUBLE) AS s, CAST(sum({q.fx('score', 4)} * {q.fx('score', 4)}) AS DOUBLE) AS ss FROM fused GROUP BY 1),
  met AS (SELECT aoi_id, cells, {q.rd('s / cells / 1e4')} AS mean_score, CASE WHEN cells > 1 THEN {q.rd('sqrt(greatest(0e0, cells * ss - s * s) / (CAST(cells AS DOUBLE) * cells)) / 1e4')} ELSE 0e0 END AS flatness FROM mm)"""


@register("run_metrics", f"{_RUNM} SELECT * FROM met")
def run_metrics(spark, d):
    return ev.map_metrics(fused_scores(spark, d), ["aoi_id"])


_WK = "wk AS (SELECT c_custkey AS site_id, c_custkey % 100 AS aoi_id, c_custkey * 7 % 130 AS cell_key FROM customer)"


@register("working_percentiles", f"""{_FUSED}, {_WK}, pc AS (SELECT aoi_id, cell_key, (rank() OVER (PARTITION BY aoi_id ORDER BY score) - 1 + count(*) OVER (PARTITION BY aoi_id, score) / 2e0)
  / count(*) OVER (PARTITION BY aoi_id) AS p FROM fused) SELECT wk.aoi_id, count(*) AS workings, count(p) AS found, count(*) - count(p) AS missed,
  {q.rd(f"CAST(sum({q.fx('p')}) AS DOUBLE) / nullif(count(p), 0) / 1e9")} AS mean_percentile, {q.rd("CAST(sum(CASE WHEN p >= 0.9e0 THEN 10 ELSE 0 END) AS DOUBLE) / nullif(count(p), 0) / 1e1")} AS recall_at_high
  FROM wk LEFT JOIN pc USING (aoi_id, cell_key) GROUP BY 1""")
def _(spark, d):
    wk = table(spark, d, "customer").selectExpr("c_custkey AS site_id", "c_custkey % 100 AS aoi_id", "c_custkey * 7 % 130 AS cell_key")
    return ev.workings_metrics(wk, fused_scores(spark, d), ["aoi_id"], ["cell_key"])


_AR = f"""{_RUNM.replace('WITH ', 'WITH ' + with_views('aoi')[5:] + ', ', 1)}, ar AS (SELECT a.aoi_id % 25 AS area, any_value(CASE (a.aoi_id % 25) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'control' ELSE 'null' END) AS label,
  any_value((a.aoi_id % 25) % 2 = 0) AS toponym_revealing, count(*) AS n_runs, {q.rd(_M4.format(x='mean_score'))} AS mean_score, {q.rd(_M4.format(x='flatness'))} AS flatness
  FROM aoi a JOIN met USING (aoi_id) GROUP BY 1)"""


def areas(spark, d):
    area = (F.col("aoi_id") % 25).alias("area")
    runs_ = run_metrics(spark, d).join(view(spark, d, "aoi").select("aoi_id"), "aoi_id").withColumn("area", area)
    means = ev.area_means(runs_, ["area"], ["mean_score", "flatness"])
    k = F.col("area") % 3
    return means.withColumns({"label": F.when(k == 0, "positive").when(k == 1, "control").otherwise("null"), "toponym_revealing": F.col("area") % 2 == 0})


@register("area_means", f"{_AR} SELECT * FROM ar")
def _(spark, d):
    return areas(spark, d)


_P = lambda c: q.rd("CAST(sum(CAST(floor(mean_score * 1e4 + 0.5e0) AS BIGINT)) FILTER (" + c + ") AS DOUBLE) / nullif(count(*) FILTER (" + c + "), 0) / 1e4")
_SUM = f"""{_AR}, su AS (SELECT count(*) AS areas, {_P("label = 'positive'")} AS mean_positive, {_P("label = 'null'")} AS mean_null, {_P("label = 'positive' AND NOT toponym_revealing")} AS blind FROM ar)"""


@register("label_summary", f"""{_SUM} SELECT areas, mean_positive, mean_null, {q.rd('mean_positive - mean_null')} AS separation, {q.rd('blind - mean_null')} AS separation_blind FROM su""")
def summary(spark, d):
    return ev.label_summary(areas(spark, d))


_NS = f"""{with_views('run')}, rm AS (SELECT r.aoi_id, r.git_commit, r.git_dirty, {q.rd('o_totalprice / 1e6')} AS mean_score FROM run r JOIN orders o ON o.o_orderkey = r.run_id WHERE r.status = 'completed'),
  ns AS (SELECT aoi_id, git_commit, count(*) AS n, {q.rd('max(mean_score) - min(mean_score)')} AS spread FROM rm WHERE NOT git_dirty GROUP BY 1, 2 HAVING count(*) >= 2)"""


def samples(spark, d):
    price = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), sc.round_dp(F.col("o_totalprice").cast("double") / 1e6, 4).alias("mean_score"))
    return ev.noise_samples(view(spark, d, "run").where("status = 'completed'").join(price, "run_id"), "aoi_id")


@register("noise_samples", f"{_NS} SELECT * FROM ns")
def _(spark, d):
    return samples(spark, d)


@register("noise_floor", f"{_NS} SELECT max(spread) AS floor, {q.rd(_M4.format(x='spread'))} AS mean_spread FROM ns")
def _(spark, d):
    return ev.noise_floor(samples(spark, d))


@register("delta_vs_baseline", f"""{_SUM}, nw AS (SELECT unnest([{{metric: 'mean_positive', v: mean_positive}}, {{metric: 'mean_null', v: mean_null}}, {{metric: 'separation', v: {q.rd('mean_positive - mean_null')}}}]) AS m FROM su)
  SELECT m.metric AS metric, 0.49e0 AS baseline, m.v AS now, {q.rd('m.v - 0.49e0')} AS delta, CASE WHEN abs(m.v - 0.49e0) > 0.01e0 THEN 'yes' ELSE 'no — within noise' END AS exceeds_floor FROM nw""")
def _(spark, d):
    now = ev.metric_rows(summary(spark, d), [], ["mean_positive", "mean_null", "separation"])
    base = now.select("metric", F.lit(0.49).alias("value"))
    return ev.delta_verdict(now, base, spark.range(1).select(F.lit(0.01).alias("floor")))


@register("workings_gate", f"""SELECT s_suppkey AS aoi_id, s_suppkey % 5 > 0 AND s_suppkey % 3 = 0 AS ok, CASE WHEN s_suppkey % 5 = 0 THEN
  'no known_workings — assign workings first; if there are still none, this AOI has no survey- or topo-grade gold occurrence within its radius'
  WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 5) || ' working(s) present but workings_verified is false — for a null/control AOI that means the workings contradict the label and a human has to resolve it before the numbers mean anything'
  ELSE '' END AS reason FROM supplier""")
def _(spark, d):
    ok, reason = ev.workings_gate(F.col("s_suppkey") % 5, F.col("s_suppkey") % 3 == 0)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("aoi_id"), ok.alias("ok"), reason.alias("reason"))


@register("report_rows", f"""{_RUNM} SELECT aoi_id, m.metric AS metric, m.value AS value FROM (SELECT aoi_id, unnest([{{metric: 'cells', value: CAST(cells AS DOUBLE)}}, {{metric: 'mean_score', value: mean_score}}, {{metric: 'flatness', value: flatness}}]) AS m FROM met)""")
def _(spark, d):
    return ev.metric_rows(run_metrics(spark, d), ["aoi_id"], ["cells", "mean_score", "flatness"])


@register("both_models_cells", f"""{_LAST} SELECT aoi_id, count(*) AS shared FROM (SELECT aoi_id, cell_key FROM last WHERE agent_id = 'AF' INTERSECT SELECT aoi_id, cell_key FROM last WHERE agent_id = 'NO') GROUP BY 1""")
def _(spark, d):
    s = last_scores(spark, d)
    return s.where("agent_id = 'AF'").select("aoi_id", "cell_key").join(s.where("agent_id = 'NO'").select("aoi_id", "cell_key"), ["aoi_id", "cell_key"]).groupBy("aoi_id").agg(F.count("*").alias("shared"))


@register("high_and_novel", f"""{_RANKED}, nv AS (SELECT *, CASE cell_key % 4 WHEN 0 THEN 'lead' WHEN 1 THEN 'extends' WHEN 2 THEN 'confirms' END AS novelty FROM tiered)
  SELECT aoi_id, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'high' AND novelty = 'lead') AS high_leads, count(*) FILTER (novelty IS NULL) AS unknown FROM nv GROUP BY 1""")
def _(spark, d):
    k = F.col("cell_key") % 4
    nv = F.when(k == 0, "lead").when(k == 1, "extends").when(k == 2, "confirms")
    high = F.col("tier") == "high"
    return cells_ranked(spark, d).withColumn("novelty", nv).groupBy("aoi_id").agg(
        F.count_if(high).alias("high"), F.count_if(high & (F.col("novelty") == "lead")).alias("high_leads"), F.count_if(F.col("novelty").isNull()).alias("unknown"))
