"""Joins of exploded rows: none may go through the driver by an estimate made before the rows were exploded."""
import pytest
from pyspark.sql import functions as F

from lodegrid.catalog import load_all
from lodegrid.catalog.registry import QUERIES
from lodegrid.operators import overlay, spatial


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["polygon_area", "polygon_cell_overlay", "polygon_file_overlay", "cell_unit_shares", "polygons_simplified"])
def test_edges_are_not_broadcast(spark, sf, name):
    load_all()
    assert "Broadcast" not in plan_of(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["cell_district", "cell_occurrence_facts"])
def test_cells_are_not_broadcast(spark, sf, name):
    load_all()
    assert "Broadcast" not in plan_of(QUERIES[name](spark, sf))


def test_rings_get_their_sign_without_a_join(spark):
    ring = "array(struct(0D AS x, 0D AS y), struct(0D AS x, 2D AS y), struct(2D AS x, 2D AS y), struct(2D AS x, 0D AS y), struct(0D AS x, 0D AS y))"
    df = spark.sql(f"SELECT id, array(CASE WHEN id = 0 THEN {ring} ELSE reverse({ring}) END) AS rings FROM range(2)")
    edges = overlay.ring_edges(df, ["id"], degrees=False)
    assert "Join" not in plan_of(edges) and "Exchange" not in plan_of(edges)
    area = edges.groupBy("id").agg(F.sum(F.col("orient") * (F.col("xb") - F.col("xa")) * (F.col("ya") + F.col("yb")) / 2).alias("a"))
    assert [r["a"] for r in area.orderBy("id").collect()] == [4.0, 4.0]


def test_equal_sites_and_centres_are_met_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def away(sx, cx):
        met.add(1)
        return abs(sx - cx)

    sites = spark.range(40).select(F.col("id").alias("site_key"), F.lit(1.0).alias("sx"), F.lit(1.0).alias("sy"))
    centres = spark.range(30).select((30 - F.col("id")).alias("centre"), F.lit(1.5).alias("cx"), F.lit(1.0).alias("cy"))
    best = spatial.nearest_within(sites, centres, "centre", away("sx", "cx"), F.lit(1.0), F.lit(1.0), 2.0, F.col("_d") <= 1)
    got = best.collect()
    assert sorted(r["site_key"] for r in got) == list(range(40)) and {(r["distance"], r["centre"]) for r in got} == {(0.5, 1)}
    assert met.value < 10  # 1,200 pairs of the given rows


def test_edges_of_one_file_are_dealt_out_before_they_become_cells(spark):
    ring = "array(struct(0D AS x, 0D AS y), struct(9e4 AS x, 0D AS y), struct(9e4 AS x, 9e4 AS y), struct(0D AS x, 9e4 AS y), struct(0D AS x, 0D AS y))"
    df = spark.sql(f"SELECT id, array({ring}) AS rings FROM range(64)").coalesce(1)
    cells = overlay.polygon_cells(overlay.ring_edges(df, ["id"], degrees=False), ["id"], 1000)
    plan = plan_of(cells)
    # Below the explosion into columns and rows of cells stands a shuffle by number.
    assert "REPARTITION_BY_NUM" in plan and plan.rindex("sequence(") > plan.index("HashAggregate")
