import pytest
from pyspark.sql import functions as F

from lodegrid.catalog import load_all
from lodegrid.catalog.registry import QUERIES
from lodegrid.operators import evaluation as ev
from lodegrid.operators import ranking
from lodegrid.plans import benchmark


def inputs(spark):
    """Run 1 is larger than the others, run 4 has no cells, run 5 none that the model scores; area 2 is not verified, area 3 has no sites."""
    runs = spark.createDataFrame([(1, 1, "a", False, 0), (2, 1, "a", True, 1), (3, 2, "b", False, 2), (4, 1, "b", False, 3), (5, 1, "c", False, 4), (6, 3, "c", False, 5)],
                                 "run_id bigint, aoi_id bigint, git_commit string, git_dirty boolean, cache_hits bigint")
    cells = spark.range(40).select(F.lit(1).cast("bigint").alias("run_id"), F.col("id").alias("col"), F.lit(0).cast("bigint").alias("row"), (F.col("id") % 7 / 10).alias("score"))
    some = [(r, c, 0, s) for r in (2, 3, 6) for c, s in ((0, 0.3), (1, 0.3), (2, 0.9), (3, None), (5, 0.1))] + [(5, 4, 0, 0.5), (None, 1, 0, 0.5)]
    cells = cells.unionByName(spark.createDataFrame(some, "run_id bigint, col bigint, row bigint, score double"))
    model = spark.range(40).select(F.col("id").alias("col"), F.lit(0).cast("bigint").alias("row"), F.when(F.col("id") != 4, F.col("id") % 5 / 10).alias("model_score"))
    sites = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 1, 0), (1, 3, 2, 0), (1, 4, 77, 0), (1, 5, 4, 0), (2, 6, 1, 0)], "aoi_id bigint, site_uid bigint, col bigint, row bigint")
    areas = spark.createDataFrame([(1, True), (2, False), (3, True)], "aoi_id bigint, workings_verified boolean")
    return cells, model, runs, sites, areas


def in_parts(cells, model, runs, sites, areas):
    """The same metrics, each by its own operator over its own rows, sites listed for every run."""
    keys = ["run_id"]
    shared = cells.join(model.where("model_score is not null"), ["col", "row"])
    wanted = runs.where("aoi_id = 1").select("run_id", "aoi_id").join(sites, "aoi_id")
    known = ev.workings_metrics(wanted, cells, keys, ["col", "row"])
    by_model = ev.workings_metrics(wanted, shared.select("run_id", "col", "row", F.col("model_score").alias("score")), keys, ["col", "row"])
    out = runs.select("run_id").join(ev.map_metrics(cells, keys), keys, "left").join(
        ev.map_metrics(shared, keys, "model_score").toDF("run_id", "model_cells", "model_mean", "model_flatness"), keys, "left").join(
        ranking.spearman(shared, keys, "score", "model_score").toDF("run_id", "spearman_n", "spearman"), keys, "left").join(known, keys, "left")
    return out.join(by_model.select("run_id", *[F.col(c).alias(f"{c}_model") for c in ("found", "mean_percentile", "recall_at_high")]), keys, "left")


@pytest.mark.parametrize("whole", [1_000_000, 10])
def test_report_equals_its_parts(spark, monkeypatch, whole):
    monkeypatch.setattr(ranking, "WHOLE", whole, raising=False)
    tables = inputs(spark)
    want = in_parts(*tables).orderBy("run_id").collect()
    got = benchmark.run_report(*tables).select(*want[0].asDict()).orderBy("run_id").collect()
    assert got == want
    assert (got[3].found, got[3].missed, got[3].cells) == (0, 5, None) and got[4].model_cells is None and got[5].workings is None


def test_small_maps_are_not_dealt_by_range(spark, monkeypatch):
    def dealt(*_):
        raise AssertionError("rows of small groups are sampled, sorted by range and stored")

    tables = inputs(spark)
    monkeypatch.setattr(ranking, "dealt_by_range", dealt)
    assert benchmark.run_report(*tables).count() == 6


def test_baseline_reads_the_report_once(spark, sf, monkeypatch):
    load_all()
    from lodegrid.catalog import reports

    rows, report = spark.sparkContext.accumulator(0), reports.run_report

    def counted(spark, d):
        made = report(spark, d)

        def count(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return made.mapInArrow(count, made.schema)

    monkeypatch.setattr(reports, "run_report", counted)
    assert QUERIES["against_frozen_baseline"](spark, sf).count() > 0
    assert rows.value == spark.read.parquet(f"{sf}/orders.parquet").count()
