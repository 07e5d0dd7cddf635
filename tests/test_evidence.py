import pytest
from pyspark.sql import functions as F

from lodegrid import fixed
from lodegrid.functions import grid as g
from lodegrid.operators import spatial, toponyms as tp, wofe

SCHEMA = "col int, row int, geol_unit string, geol_unit_frac double, fault_code int, fold_code int, dike_unit string"


def patch(spark, special):
    """A barren 40 x 40 patch with some cells replaced."""
    rows = []
    for c in range(2240, 2280):
        for r in range(1590, 1630):
            unit, frac, fault = special.get((c, r), ("Kigd", 1.0, None))
            rows.append((c, r, unit, frac, fault, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def score(spark, cells, ids, **kw):
    df = spark.createDataFrame([(i,) for i in ids], "cell_id string")
    return {r.cell_id: r for r in wofe.score_requests(df, cells, **kw).collect()}


def cid(res, c, r):
    return f"wa5070-{res}m-{c:06d}-{r:06d}"


def test_native_tracts_and_bands(spark):
    cells = patch(spark, {(2250, 1600): ("Evsf", 0.8, 43), (2270, 1620): ("Eck", 1.0, None)})
    got = score(spark, cells, [cid(250, 2250, 1600), cid(250, 2251, 1600), cid(250, 2270, 1620), cid(250, 2242, 1628)])
    assert got[cid(250, 2250, 1600)].tract == "favourable" and 0.70 <= got[cid(250, 2250, 1600)].score <= 0.95
    neighbour = got[cid(250, 2251, 1600)]
    assert neighbour.tract == "favourable" and neighbour.litho_buffer_only and neighbour.fault_distance_m == 250.0
    assert got[cid(250, 2270, 1620)].tract == "permissive" and got[cid(250, 2242, 1628)].tract == "non_permissive"


def test_fault_beyond_reach_is_unknown(spark):
    cells = patch(spark, {(2240, 1590): ("Kigd", 1.0, 7)})
    got = score(spark, cells, [cid(250, 2256, 1590), cid(250, 2257, 1590), cid(250, 2252, 1602)])
    assert got[cid(250, 2256, 1590)].fault_distance_m == 4000.0 and got[cid(250, 2257, 1590)].fault_distance_m is None
    assert got[cid(250, 2252, 1602)].fault_distance_m is None  # 16.97 cells away


def test_refusals(spark):
    cells = patch(spark, {})
    got = score(spark, cells, [cid(250, 10, 10), "nonsense", cid(4000, 142, 99)])
    assert got[cid(250, 10, 10)].refused == fixed.REFUSED_OUTSIDE and got[cid(250, 10, 10)].score is None
    assert got["nonsense"].refused == fixed.REFUSED_BAD_ID
    assert got[cid(4000, 142, 99)].refused == fixed.REFUSED_PARTIAL
    assert "copper" in score(spark, cells, [cid(250, 2250, 1600)], mineral="Copper")[cid(250, 2250, 1600)].refused


def test_coarse_cell_is_mean_of_children(spark):
    special = {(2400 - 160 + c, 1600 + r): ("Evsf", 1.0, 33) for c in (0, 1) for r in (0, 1)}
    cells = patch(spark, special)
    parent, kids = cid(1000, 560, 400), [cid(250, 2240 + c, 1600 + r) for c in range(4) for r in range(4)]
    got = score(spark, cells, [parent] + kids)
    assert got[parent].score == pytest.approx(sum(got[k].score for k in kids) / 16, abs=1e-4)
    assert got[parent].wofe_cells == 16 and got[parent].tract_fracs["favourable"] == pytest.approx(9 / 16, abs=1e-3)


def test_finer_cell_inherits(spark):
    cells = patch(spark, {(2250, 1600): ("Evsf", 0.8, 43)})
    got = score(spark, cells, [cid(125, 4501, 3201), cid(250, 2250, 1600)])
    assert got[cid(125, 4501, 3201)].score == got[cid(250, 2250, 1600)].score and got[cid(125, 4501, 3201)].inherited_from_250m


def test_trend_shifts_score(spark):
    cells = patch(spark, {(2250, 1600): ("Evsf", 0.8, 43)})
    one = cid(250, 2250, 1600)
    trend = lambda v: spark.createDataFrame([(one, v)], "cell_id string, favourable_trend boolean")
    low, high = (score(spark, cells, [one], trend=trend(v))[one].score for v in (False, True))
    assert low < score(spark, cells, [one])[one].score < high


def test_nearest_point_matches_brute_force(spark):
    a = spark.range(60).select("id", (F.lit(-124.0) + F.col("id") * 7919 % 7000 / 1e3).alias("lon"), (F.lit(45.8) + F.col("id") * 389 % 3000 / 1e3).alias("lat"))
    b = spark.range(40).select((F.lit(-123.9) + F.col("id") * 613 % 700 / 1e3).alias("lon"), (F.lit(45.9) + F.col("id") * 577 % 300 / 1e3).alias("lat"), F.col("id").cast("string").alias("name"))
    ours = {r.id: r.nearest_km for r in spatial.nearest_point(a, b, "id", "name").collect()}
    import math
    pts = [(r.lon, r.lat) for r in b.collect()]
    for r in a.collect():
        best = min(math.hypot((x - r.lon) * math.cos(math.radians((y + r.lat) / 2)) * 111.32, (y - r.lat) * 110.574) for x, y in pts)
        assert ours[r.id] == pytest.approx(best, abs=1e-9)


def test_sparse_interpolation_widens_until_exact(spark):
    coarse = spark.createDataFrame([("a", 0, 0, 0.1, 0.5), ("a", 9, 0, 0.9, 0.5), ("a", 0, 9, 0.4, 0.5), ("a", 9, 9, 0.6, 0.5), ("a", 4, 4, 0.2, 1.0)],
                                   "aoi string, col int, row int, score double, confidence double")
    fine = spark.range(400).select(F.lit("a").alias("aoi"), (F.col("id") % 20).cast("int").alias("col"), F.floor(F.col("id") / 20).cast("int").alias("row"))
    got = {(r.col, r.row): r for r in spatial.interpolate(fine, coarse, ["aoi"], 500, 1000).collect()}
    pts = [(r.col, r.row, r.score) for r in coarse.collect()]
    for (c, r), row in got.items():
        d = sorted((((2 * x + 1) * 2 - (2 * c + 1)) ** 2 + ((2 * y + 1) * 2 - (2 * r + 1)) ** 2, x, y, s) for x, y, s in pts)[:4]
        want = sum(s / k for k, _, _, s in d) / sum(1 / k for k, *_ in d)
        assert row.score == pytest.approx(want, abs=1.01e-4)
    assert len(got) == 400


def test_lexicon_false_friends(spark):
    names = [("Goldmyer Hot Springs", "Spring"), ("Mill Creek", "Stream"), ("Gold Bar", "Locale"), ("Bonanza Peak", "Summit"), ("Red Mountain", "Summit"),
             ("Red Creek", "Stream"), ("Ironwood Flat", "Flat"), ("Miners Ridge", "Ridge"), ("Golden", "Civil"), ("Marigold Lake", "Lake"), ("Discovery Claim", "Locale"), ("Discovery Bay", "Bay")]
    df = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(names)], "feature_id int, name string, feature_class string")
    got = {r.name: r.tier for r in tp.match_names(df, tp.Lexicon()).collect()}
    assert got == {"Goldmyer Hot Springs": 5, "Mill Creek": 5, "Gold Bar": 5, "Bonanza Peak": 2, "Red Mountain": 4, "Ironwood Flat": 5, "Miners Ridge": 1,
                   "Discovery Claim": 1, "Discovery Bay": 5}


def test_novelty_thresholds(spark):
    from lodegrid.functions.scalars import novelty
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 0.5, 0.51, 2.0, 2.01, 9.0, None])], "i int, km double").orderBy("i")
    assert [r[0] for r in df.select(novelty(F.col("km"))).collect()] == ["confirms", "confirms", "extends", "extends", "lead", "lead", None]


def test_empty_layer_is_unknown_not_zero(spark):
    cells = spark.createDataFrame([("a", 350, 380)], "aoi string, col int, row int")
    near = spark.createDataFrame([], "aoi string, col int, row int, site_id int, name string, accuracy_class string, assays boolean, production boolean, distance_m double")
    unknown = spatial.occurrence_facts(cells, near, ["aoi", "col", "row"], any_points=False).first()
    none_near = spatial.occurrence_facts(cells, near, ["aoi", "col", "row"], any_points=True).first()
    assert unknown.n_1km is None and none_near.n_1km == 0 and none_near.nearest_km is None
