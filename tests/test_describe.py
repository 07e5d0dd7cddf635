"""Lines made from facts, and fact tables joined as they are stored."""
from pyspark.sql import functions as F

from lodegrid.operators import describe


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_the_first_alternative_whose_facts_are_known_is_taken(spark):
    text = lambda **facts: one(spark, describe.render("lithology", {k: F.lit(v) for k, v in facts.items()}))
    assert text() is None
    assert text(raster_unit="Kigd") == "raster unit Kigd holds no training site"
    assert text(units="Evk 60%", ranked="Evk", contrast=2.5, formation="F") == "mapped rock: Evk 60%; ranked unit Evk: contrast 2.5, F"
    assert text(ranked="Evk", contrast=2.5, formation="F", share=40, raster_unit="x") == "ranked unit Evk: contrast 2.5, F, over 40% of the cell"


def test_facts_asked_for_but_not_printed(spark):
    text = lambda **facts: one(spark, describe.render("proximity", {k: F.lit(v) for k, v in facts.items()}))
    assert text(nearest_name="A", nearest_km=1.5, rough="yes") == "nearest record A, 1.5 km, its position too rough to argue from"
    assert text(nearest_name="A", nearest_km=1.5) == "nearest record A, 1.5 km"
    assert text(empty="yes", district="D", in_district="yes", district_km=0.0) == "no record within 5 km; in district D"
    assert text(district="D", district_km=2.5) == "district D at 2.5 km"


def test_every_template_names_known_facts():
    from string import Formatter
    names = {n for slots in describe.LINES.values() for slot in slots for t in slot for _, n, _, _ in Formatter().parse(t) if n}
    none = F.lit(None)
    wofe = none.cast("struct<favourable_unit:string,favourable_frac:double,favourable_contrast:double,formation:string,unit:string,fault_codes:array<int>,fold_codes:array<int>,dike_units:array<string>,has_predictor_fault:boolean>")
    lines = none.cast("struct<count:bigint,kinds:array<struct<kind:string,n:bigint,km:double>>,azimuths:array<double>,favourable_azimuths:array<double>,named:array<string>,nearest_km:double,nearest_kind:string,fault_intersections_in_cell:bigint>")
    made = {**describe.rock_facts(none.cast("array<struct<unit:string,name:string,lithology:string,frac:double>>"), wofe), **describe.line_facts(lines, wofe),
            **describe.site_facts(none.cast("struct<nearest_name:string,nearest_km:double,nearest_accuracy:string,n_near:int,n_in_cell:int,n_1km:int,n_2km:int,with_production:int,with_assays:int>")),
            **describe.district_facts(none.cast("struct<name:string,inside:boolean,km:double>")), **describe.district_history(none, none, none),
            **describe.record_facts(none.cast("array<struct<ore_minerals:string,gangue:string>>"), none),
            **describe.nearby_facts(*[none.cast("array<struct<name:string,km:double>>")] * 2, none.cast("array<struct<name:string,tier:int,corroboration:string>>")), "best": none}
    assert names <= set(made)


def test_nine_stored_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cells = spark.range(50).select((F.col("id") % 5).alias("aoi"), F.col("id").alias("cell"))
        keys = ["aoi", "cell"]
        tables = {f"t{i}": describe.stored(cells.where(f"cell % {i + 2} = 0").withColumn("v", F.lit(i)), keys, f"t{i}") for i in range(9)}
        out = describe.assemble(describe.stored(cells, keys, "cells"), keys, tables)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        counts = {r["aoi"]: r for r in describe.census(out, ["aoi"], list(tables)).collect()}
        assert counts[0]["cells_total"] == 10 and sum(r["cells_with_t1"] for r in counts.values()) == 17
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
