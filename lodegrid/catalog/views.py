"""Domain views over the given tables, as (table, columns, filter), for Spark and for SQL alike."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "agent_score": ("lineitem", {
        "aoi_id": "l_suppkey", "cell_key": "l_partkey % 100", "agent_id": "l_returnflag || l_linestatus",
        "score": "CAST(l_discount AS DOUBLE) * 10e0", "confidence": "CAST(l_tax AS DOUBLE) * 12.5e0",
        "ord1": "l_orderkey", "ord2": "l_linenumber", "ord3": "CAST(l_extendedprice AS DOUBLE)",
    }, None),
    "wofe_cell": ("orders", {
        "col": "CAST(2240 + o_orderkey % 120 AS INT)",
        "row": "CAST(1590 + floor(o_orderkey / 120) AS INT)",
        "geol_unit": "CASE o_custkey % 12 WHEN 0 THEN 'Eck' WHEN 1 THEN 'Evkct' WHEN 2 THEN 'Evst' WHEN 3 THEN 'Evsf' "
                     "WHEN 4 THEN 'Evkf' WHEN 5 THEN 'Eco' WHEN 6 THEN NULL ELSE 'Kigd' END",
        "geol_unit_frac": "CAST(50 + o_orderkey % 51 AS DOUBLE) / 100e0",
        "fault_code": "CAST(CASE o_custkey % 29 WHEN 0 THEN 43 WHEN 1 THEN 7 WHEN 2 THEN 31 END AS INT)",
        "fold_code": "CAST(CASE o_custkey % 31 WHEN 0 THEN 1 WHEN 1 THEN 13 END AS INT)",
        "dike_unit": "CASE o_custkey % 37 WHEN 0 THEN 'Eid' WHEN 1 THEN 'Kid' END",
    }, None),
    "occurrence": ("customer", {
        "site_id": "c_custkey", "name": "c_name", "lon": "-124.5e0 + (c_custkey * 7919 % 8000) / 1e3",
        "lat": "45.6e0 + (c_custkey * 104729 % 3300) / 1e3", "assays": "c_acctbal > 5000",
        "production": "c_mktsegment IN ('BUILDING','MACHINERY')",
        "accuracy_class": "CASE c_nationkey % 6 WHEN 0 THEN 'survey' WHEN 1 THEN 'topo' WHEN 2 THEN 'derived' "
                          "WHEN 3 THEN 'variable' WHEN 4 THEN 'district_centroid' ELSE 'unknown' END",
        "commodity_primary": "CASE c_nationkey % 4 WHEN 0 THEN 'Gold (Au)' WHEN 1 THEN 'Silver (Ag)' "
                             "WHEN 2 THEN 'Copper (Cu)' ELSE 'Lead (Pb)' END",
        "district": "CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'District ' || CAST(c_nationkey AS STRING) END",
    }, None),
    "place_name": ("part", {
        "feature_id": "p_partkey", "name": "p_name",
        "feature_class": "CASE p_size % 4 WHEN 0 THEN 'Stream' WHEN 1 THEN 'Summit' WHEN 2 THEN 'Ridge' ELSE 'Civil' END",
        "lon": "-124e0 + (p_partkey * 3571 % 7000) / 1e3", "lat": "45.8e0 + (p_partkey * 7321 % 3000) / 1e3",
        "source_lon": "CASE WHEN p_size % 4 = 0 THEN -124e0 + (p_partkey * 3571 % 7000) / 1e3 + (p_size % 7) / 1e2 END",
        "source_lat": "CASE WHEN p_size % 4 = 0 THEN 45.8e0 + (p_partkey * 7321 % 3000) / 1e3 + (p_size % 5) / 1e2 END",
    }, None),
    "pixel": ("lineitem", {
        "col": "CAST(l_orderkey % 64 AS INT)", "row": "CAST(l_partkey % 64 AS INT)", "value": "CAST(l_quantity AS INT)",
    }, None),
    "aoi": ("supplier", {
        "aoi_id": "s_suppkey", "lon": "-124e0 + (s_suppkey * 613 % 7000) / 1e3",
        "lat": "45.8e0 + (s_suppkey * 389 % 3000) / 1e3", "radius_km": "2e1",
        "label": "CASE s_nationkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'control' ELSE 'null' END",
        "toponym_revealing": "s_nationkey % 2 = 0",
    }, None),
    "run": ("orders", {
        "run_id": "o_orderkey", "aoi_id": "o_custkey % 10", "git_commit": "o_orderpriority",
        "git_dirty": "o_orderstatus = 'P'",
        "status": "CASE WHEN o_orderkey % 17 = 0 THEN 'failed' ELSE 'completed' END", "created_at": "o_orderdate",
    }, None),
    "telemetry": ("events", {
        "event_id": "event_id", "ts": "ts", "run_id": "user_id", "agent_id": "event_type",
        "input_tokens": "CAST(floor(value * 100) AS BIGINT)",
        "output_tokens": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)",
    }, None),
    "raw_feature": ("orders", {
        "source_channel": "'orders'", "source_record_id": "o_custkey", "version": "o_orderkey",
        "ingested_at": "o_orderdate", "status": "o_orderpriority", "value": "CAST(o_totalprice AS DOUBLE)",
    }, None),
    "doc_page": ("documents", {
        "doc": "CAST(floor(doc_id / 10) AS BIGINT)", "page": "doc_id % 10 + 1", "text": "text",
    }, None),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, where = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if where:
        df = df.where(where)
    return df.selectExpr(*[f"{expr} AS `{alias}`" for alias, expr in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(expr: str) -> str:
    return expr.replace("AS STRING", "AS VARCHAR")


def cte(name: str) -> str:
    """``name AS (SELECT ...)`` for a WITH clause."""
    table_name, columns, where = VIEWS[name]
    cols = ", ".join(f'{duck(expr)} AS "{alias}"' for alias, expr in columns.items())
    tail = f" WHERE {duck(where)}" if where else ""
    return f"{name} AS (SELECT {cols} FROM {table_name}{tail})"


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(cte(n) for n in names)
