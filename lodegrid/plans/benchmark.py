"""Both scorers against known sites, over all runs at once."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.operators import evaluation as ev
from lodegrid.operators import ranking
from lodegrid.session import materialise, shuffled
from lodegrid.sinks.tablelog import TableLog

#: Tasks over which the runs of one area are spread where they meet its known sites.
SALTS = 16


def run_report(run_cells: DataFrame, model_cells: DataFrame, runs: DataFrame, workings: DataFrame, areas: DataFrame) -> DataFrame:
    """Metrics per run: provenance, mean and flatness of both scorers, their correlation, known-site percentiles where allowed.

    ``run_cells`` (run_id, col, row, score), ``model_cells`` (col, row, model_score nullable), ``runs`` (run_id, aoi_id, git_commit,
    git_dirty, cache_hits), ``workings`` (aoi_id, site_uid, col, row), ``areas`` (aoi_id, workings_verified). Site metrics of
    an area whose workings are missing or not verified are refused, with the reason.
    """
    keys, spot = ["run_id"], ["aoi_id", "col", "row", "_salt"]
    counts = areas.join(workings.groupBy("aoi_id").agg(F.count("*").alias("_known")), "aoi_id", "left")
    allowed, why = ev.workings_gate(F.col("_known"), F.col("workings_verified"))
    gated = runs.join(counts, "aoi_id", "left").withColumns({"_ok": allowed, "workings_refused": F.when(~allowed, why)})
    # Sites of an area are counted per cell, so that a run meets them as one number on its own cells.
    sites = workings.groupBy("aoi_id", "col", "row").agg(F.count("*").alias("_sites"))
    sites = materialise(sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "sites")
    wide = run_cells.join(model_cells.where("model_score is not null"), ["col", "row"], "left").join(
        shuffled(gated.where("_ok").select("run_id", "aoi_id")), keys, "left")
    wide = wide.withColumn("_salt", F.pmod(F.xxhash64("run_id"), F.lit(SALTS)).cast("int")).join(sites, spot, "left")
    shared = F.when(F.col("model_score").isNotNull(), F.col("score")).alias("shared")
    placed = ranking.placed(wide.select("run_id", "score", "model_score", shared, "_sites"), keys, ["score", "shared", "model_score"])
    doubled = [F.col(f"{v}_below") * 2 + F.col(f"{v}_tied") + 1 for v in ("shared", "model_score")]
    percentile = [(F.col(f"{v}_below") + F.col(f"{v}_tied") / 2.0) / F.col(f"{v}_n") for v in ("score", "model_score")]
    sums = placed.groupBy(*keys).agg(
        F.lit(True).alias("_mapped"), *ev.map_moments("score", "_b"), *ev.map_moments("model_score", "_m"), *ranking.rank_sums(*doubled),
        *ev.site_sums(percentile[0], "_sites", "_k"), *ev.site_sums(percentile[1], "_sites", "_l"))
    out = gated.join(shuffled(sums), keys, "left")
    modelled, ok = F.col("_mn") > 0, F.col("_ok")
    found, *at_sites = ev.site_summary("_k")
    columns = {}
    for when, names, values in (
        (F.col("_mapped"), ("cells", "mean_score", "flatness"), ev.map_summary("_b")),
        (modelled, ("model_cells", "model_mean", "model_flatness"), ev.map_summary("_m")),
        (modelled, ("spearman_n", "spearman"), (F.col("_mn"), ranking.rank_correlation(F.col("_mn")))),
        (ok, ("workings", "found", "missed", "mean_percentile", "recall_at_high"), (F.col("_known"), found, F.col("_known") - found, *at_sites)),
        (ok, ("found_model", "mean_percentile_model", "recall_at_high_model"), ev.site_summary("_l")),
    ):
        columns |= {name: F.when(when, value).alias(name) for name, value in zip(names, values, strict=True)}
    return out.select(*[c for c in runs.columns if c != "workings_refused"], "workings_refused", *columns.values())


def freeze_baseline(spark: SparkSession, path: str, metrics: DataFrame, meta: dict[str, object]) -> None:
    """Metric rows (metric, value) as the baseline that later runs are compared with, and where they come from, in one commit."""
    _baseline(spark, path).publish(metrics.select("metric", "value"), meta)


def _baseline(spark: SparkSession, path: str) -> TableLog:
    return TableLog(spark, path, "metric string, value double", ["metric"])


def against_baseline(spark: SparkSession, path: str, now: DataFrame, floor: DataFrame) -> DataFrame:
    """Metric rows of today beside the frozen ones; a metric on one side only has no delta."""
    return ev.delta_verdict(now, _baseline(spark, path).read(), floor)
