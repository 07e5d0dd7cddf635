import pytest
from pyspark.sql import functions as F

from lodegrid.operators import evaluation as ev, fusion, ranking


def scores(spark, rows):
    return spark.createDataFrame(rows, "cell string, agent_id string, score double, confidence double")


def test_two_denominators(spark):
    df = scores(spark, [("a", "structure", 0.8, 1.0), ("a", "historical", 0.4, 0.5)])
    row = fusion.fuse(df, ["cell"], {"structure": 0.3, "historical": 0.2}).first()
    assert (row.score, row.confidence) == (0.7, 0.8)


def test_missing_weight_counts_one_and_zero_confidence_is_zero(spark):
    df = scores(spark, [("a", "x", 0.2, 1.0), ("a", "y", 0.6, 1.0), ("b", "x", 0.9, 0.0)])
    got = {r.cell: (r.score, r.confidence) for r in fusion.fuse(df, ["cell"], {}).collect()}
    assert got == {"a": (0.4, 1.0), "b": (0.0, 0.0)}


def test_negative_weights_are_refused(spark):
    with pytest.raises(ValueError):
        fusion.fuse(scores(spark, [("a", "x", 0.2, 1.0)]), ["cell"], {"x": -1.0})


def ranked(spark, values):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)], "aoi string, i int, score double")
    return [r for r in ranking.rank_relative(df, ["aoi"]).orderBy("i").collect()]


def test_midpoint_percentiles(spark):
    assert [r.percentile for r in ranked(spark, [0.1, 0.2, 0.2, 0.3])] == [0.125, 0.5, 0.5, 0.875]


def test_uniform_area_and_epsilon(spark):
    rows = ranked(spark, [0.5, 0.5 + 1e-10, 0.5])
    assert {r.tier for r in rows} == {"low"} and {r.relative_score for r in rows} == {0.5}


def test_ten_cells_have_one_high(spark):
    tiers = [r.tier for r in ranked(spark, [i / 10 for i in range(10)])]
    assert tiers[-1] == "high" and tiers.count("high") == 1


@pytest.fixture
def many_ranges(spark):
    """Ranges as they are on a cluster, where small ones are not put together again."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("groups", [1, 50])
def test_hot_group_matches_plain_window(spark, many_ranges, groups):
    """A group of a third or all of the rows, a value of a quarter of them, some values missing."""
    from pyspark.sql import Window
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % groups).alias("aoi"), "id",
        F.when(F.col("id") % 4 == 0, 0.25).when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 997) / 997.0).alias("score"))
    known = df.where("score is not null")
    w = Window.partitionBy("aoi").orderBy("score")
    plain = known.withColumn("r", F.rank().over(w) + (F.count("*").over(Window.partitionBy("aoi", "score")) - 1) / 2.0)
    ours = ranking.mid_rank(df, ["aoi"], "score", "r").select("id", "r")
    assert ours.where("r is not null").count() == plain.count() and ours.count() == 5000
    assert plain.select("id", "r").exceptAll(ours).isEmpty()
    found = ranking.with_positions(df, ["aoi"], "score").where("score = 0.25").groupBy("aoi").agg(F.min("tied"), F.max("tied"), F.count("*")).collect()
    assert all(r[1] == r[2] == r[3] for r in found)


def test_a_hot_group_is_dealt_to_many_ranges(spark, many_ranges):
    df = spark.range(4000).select(F.lit(1).alias("aoi"), "id", F.when(F.col("id") % 3 > 0, 0.5).otherwise(F.col("id") / 4000).alias("score"))
    sizes = ranking.dealt_by_range(df, ["aoi", "score", F.xxhash64("aoi", "id")]).groupBy("_part").count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 800


def test_numbers_of_rows_match_a_plain_window(spark, many_ranges):
    from pyspark.sql import Window
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 31 % 100).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    plain = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint").alias("i"))
    assert plain.exceptAll(ranking.numbered(df, ["k"], order, "i").select("id", "i")).isEmpty()


def test_spearman_ties_and_undefined(spark):
    rows = [("t", x, y) for x, y in zip([1, 2, 3, 4, 5], [2, 2, 3, 1, 5])] + [("c", i, 1) for i in range(5)] + [("s", 1, 1), ("s", 2, 2)]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], "k string, x double, y double")
    got = {r.k: r.rho for r in ranking.spearman(df, ["k"], "x", "y", 7).collect()}
    assert got["t"] == pytest.approx(0.3590924, abs=1e-6) and got["c"] is None and got["s"] is None


def test_partition_count_does_not_change_fusion(spark, sf):
    from lodegrid.catalog import load_all
    from lodegrid.catalog.scoring import WEIGHTS, last_scores
    load_all()
    base = last_scores(spark, sf)
    a = fusion.fuse(base.repartition(1), ["aoi_id", "cell_key"], WEIGHTS)
    b = fusion.fuse(base.repartition(7), ["aoi_id", "cell_key"], WEIGHTS)
    assert a.exceptAll(b).isEmpty()


def test_noise_floor_and_delta(spark):
    runs = spark.createDataFrame([("a", "c1", False, 0.5), ("a", "c1", False, 0.53), ("a", "c2", False, 0.9), ("a", "c1", True, 0.0)],
                                 "aoi string, git_commit string, git_dirty boolean, mean_score double")
    floor = ev.noise_floor(ev.noise_samples(runs, "aoi"))
    assert floor.first().floor == 0.03
    now = spark.createDataFrame([("m", 0.60), ("k", 0.41)], "metric string, value double")
    base = spark.createDataFrame([("m", 0.50), ("k", 0.40)], "metric string, value double")
    got = {r.metric: r.exceeds_floor for r in ev.delta_verdict(now, base, floor).collect()}
    assert got == {"m": "yes", "k": "no — within noise"}
