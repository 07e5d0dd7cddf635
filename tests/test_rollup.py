import pytest

from lodegrid.operators import wofe


def native(spark, rows, cells=400):
    data = [(2240 + i % 20, 1590 + i // 20, "Eck" if i % 3 else None, 0.5, 43 if i == 50 else None, None, None) for i in range(cells)]
    made = spark.createDataFrame(data, "col int, row int, geol_unit string, geol_unit_frac double, fault_code int, fold_code int, dike_unit string")

    def count(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return made.mapInArrow(count, made.schema)


def test_native_terms_are_made_once(spark):
    """Cells, their neighbours, their faults and their number: four readings, where terms made for each use needed seven."""
    rows = spark.sparkContext.accumulator(0)
    ids = spark.createDataFrame([("wa5070-1000m-000561-000398",), ("wa5070-250m-002245-001592",)], "cell_id string")
    assert len(wofe.score_requests(ids, native(spark, rows)).collect()) == 2
    assert rows.value <= 5 * 400


def test_offsets_along_a_row_are_not_shuffled(spark):
    cells = native(spark, spark.sparkContext.accumulator(0))
    plan = wofe.fault_distance(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.col, r.row): r.fault_distance_m for r in wofe.fault_distance(cells, reach=3).collect()}
    want = {(2250 + i, 1592 + j): 250 * (i * i + j * j) ** 0.5 for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9}
    assert got == pytest.approx(want)


def test_ids_that_mean_the_same_cell_are_scored_each(spark):
    cells = native(spark, spark.sparkContext.accumulator(0))
    names = ["wa5070-1000m-000561-000398", "wa5070-01000m-000561-000398"]
    ids = spark.createDataFrame([(n,) for n in names], "cell_id string")
    trend = spark.createDataFrame([(names[0], True)], "cell_id string, favourable_trend boolean")
    plain = {r.cell_id: r for r in wofe.score_requests(ids, cells).collect()}
    assert [plain[n].wofe_cells for n in names] == [16, 16] and plain[names[0]].score == plain[names[1]].score
    shifted = {r.cell_id: r for r in wofe.score_requests(ids, cells, trend=trend).collect()}
    assert shifted[names[1]].score == plain[names[1]].score and shifted[names[0]].favourable_trend
