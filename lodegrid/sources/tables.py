"""Delimited gazetteers, run records, labels, artifact coverage and window scans."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions.scalars import clean_number, nonzero_number

BULK = ("feature_id string, feature_name string, feature_class string, state_name string, county_name string, "
        "map_name string, prim_lat_dec string, prim_long_dec string, source_lat_dec string, source_long_dec string")
GAZETTEER = ("feature_id string, name string, feature_class string, county string, map_name string, "
             "lat string, lon string, source_lat string, source_lon string")
RUN = ("run_id string, created_at string, status string, provenance struct<git_commit:string,git_dirty:boolean,model:string,"
       "agents_without_knowledge:array<string>,spatial_context_available:boolean>, inputs struct<target_mineral:string,"
       "weights:map<string,double>,aoi_geojson:string>, composite_cells array<struct<cell_id:string,score:double,confidence:double>>, "
       "agent_results map<string,struct<status:string,knowledge_file:string>>, cache struct<hits:bigint,misses:bigint>, _broken string")


def read_bulk_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", header=True, schema=BULK)


def gazetteer_extract(bulk: DataFrame, state: str = "Washington") -> DataFrame:
    """Named features of one state with a usable position, in class and name order."""
    lat, lon = clean_number(F.col("prim_lat_dec")), clean_number(F.col("prim_long_dec"))
    rows = bulk.where(F.trim("state_name") == state).withColumns({"_lat": lat, "_lon": lon})
    rows = rows.where("_lat is not null and _lon is not null and not (_lat = 0 and _lon = 0)")
    six = lambda c: F.format_string("%.6f", c)
    src = lambda c: F.when(nonzero_number(F.col(c)).isNotNull(), six(nonzero_number(F.col(c)))).otherwise("")
    return rows.select(
        "feature_id", F.col("feature_name").alias("name"), "feature_class", F.col("county_name").alias("county"), "map_name",
        six(F.col("_lat")).alias("lat"), six(F.col("_lon")).alias("lon"), src("source_lat_dec").alias("source_lat"),
        src("source_long_dec").alias("source_lon")).orderBy("feature_class", "name", "feature_id")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return load_gazetteer(spark.read.csv(path, sep="\t", header=True, schema=GAZETTEER))


def load_gazetteer(rows: DataFrame) -> DataFrame:
    """Typed names; a blank or zero source coordinate means a point feature."""
    out = rows.withColumns({
        "lat": clean_number(F.col("lat")), "lon": clean_number(F.col("lon")),
        "source_lat": nonzero_number(F.col("source_lat")), "source_lon": nonzero_number(F.col("source_lon"))})
    return out.where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")


def gazetteer_manifest(extract: DataFrame) -> DataFrame:
    """One row: count, class histogram (largest first) and the two flags."""
    classes = extract.groupBy("feature_class").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_lat") != "").alias("s"))
    return classes.agg(
        F.sum("n").alias("rows"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "feature_class"))),
                    lambda c: F.struct(c["feature_class"].alias("feature_class"), (-c["k"]).alias("n"))).alias("feature_classes"),
        F.bool_or(F.col("feature_class") == "Mine").alias("has_mine_class"),
        F.sum(F.when(F.col("feature_class") == "Stream", F.col("s")).otherwise(0)).alias("streams_with_source"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records, newest first; unreadable files are kept apart by ``broken_runs``."""
    return readable_runs(_runs(spark, path)).orderBy(F.desc("created_at"), F.desc("run_id"))


def _runs(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return run_records(raw.select(F.input_file_name().alias("path"), "value"))


def run_records(texts: DataFrame) -> DataFrame:
    """(path, value) texts as (path, r); a text that is no whole record is marked in r._broken."""
    return texts.select("path", F.from_json("value", RUN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))


def readable_runs(rows: DataFrame) -> DataFrame:
    return rows.where("r is not null and r._broken is null").select("path", "r.*").drop("_broken")


def unreadable_runs(rows: DataFrame) -> DataFrame:
    return rows.where("r is null or r._broken is not null").select("path")


def broken_runs(spark: SparkSession, path: str) -> DataFrame:
    return unreadable_runs(_runs(spark, path))


def label_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Area and working tables of a label file. The file is a small hand-kept list by nature."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    aois, workings = [], []
    for name, spec in (yaml.safe_load(text).get("aois") or {}).items():
        lon, lat = spec["approx_center"]
        aois.append((name, spec.get("label"), float(lon), float(lat), bool(spec.get("toponym_revealing")),
                     float(spec.get("radius_km") or fixed.DEFAULT_AOI_RADIUS_KM), bool(spec.get("workings_verified"))))
        for w in spec.get("known_workings") or []:
            workings.append((name, w.get("site_uid"), w.get("name"), float(w["lon"]), float(w["lat"]), w.get("accuracy_class")))
    return (
        spark.createDataFrame(aois, "aoi string, label string, lon double, lat double, toponym_revealing boolean, radius_km double, workings_verified boolean"),
        spark.createDataFrame(workings, "aoi string, site_uid string, name string, lon double, lat double, accuracy_class string"),
    )


def window_scan(cells: DataFrame, col_lo: int, col_hi: int, row_lo: int, row_hi: int) -> DataFrame:
    """Index rectangle; plain range predicates reach the parquet scan."""
    return cells.where(F.col("col").between(col_lo, col_hi) & F.col("row").between(row_lo, row_hi))


def key_lookup(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def pull_completeness(pulled: DataFrame, expected: DataFrame, cap: int) -> DataFrame:
    """Fetched against expected rows per layer, and whether the safety cap cut the pull."""
    got = pulled.groupBy("layer").agg(F.count("*").alias("fetched"))
    out = expected.join(got, "layer", "full").fillna(0, ["fetched"])
    return out.withColumns({
        "complete": F.col("fetched") == F.col("expected"), "truncated": F.col("fetched") >= cap})


def artifact_report(layers: dict[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """One row per source: is it there, and how many rows it has."""
    out = None
    for name, df in layers.items():
        row = (spark.range(1).select(F.lit(name).alias("source"), F.lit(False).alias("available"), F.lit(0).cast("bigint").alias("rows"))
               if df is None else df.agg(F.lit(name).alias("source"), F.lit(True).alias("available"), F.count("*").alias("rows")))
        out = row if out is None else out.unionByName(row)
    return out
