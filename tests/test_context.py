"""Context hashes: free of order and of the way rows are spread, and changed by what a cell was told only."""
import hashlib

from pyspark.sql import functions as F

from lodegrid.operators import context

KEYS = ["a", "c"]


def build(spark, facts, areas=((1, "x"), (2, "y")), parts=1):
    cells = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "a int, c int")
    table = spark.createDataFrame(facts, "a int, c int, name string, km double").repartition(parts)
    other = spark.createDataFrame([(1, 1, 5)], "a int, c int, n int")
    area = spark.createDataFrame(list(areas), "a int, label string")
    return context.context_hashes(cells, KEYS, {"t": table, "u": other}, "a", {"area": area})


FACTS = [(1, 1, "p", 1.5), (1, 1, "q", None), (1, 1, "q", None), (1, 2, None, 2.0), (2, 1, "r", 0.0)]


def as_dict(df):
    return {(r.a, r.c): r.context_hash for r in df.collect()}


def test_order_and_spread_do_not_matter_but_counts_do(spark):
    base = as_dict(build(spark, FACTS))
    assert base == as_dict(build(spark, FACTS[::-1], parts=5)) and len(base) == 4
    once = as_dict(build(spark, [f for i, f in enumerate(FACTS) if i != 2]))
    assert {k for k in base if base[k] != once[k]} == {(1, 1)}


def test_a_change_sends_only_its_cells_back(spark):
    base = build(spark, FACTS)
    moved = build(spark, [(1, 2, None, 2.5) if f[1] == 2 else f for f in FACTS])
    assert sorted(tuple(r) for r in context.cells_to_rescore(base, moved, KEYS).collect()) == [(1, 2)]
    relabelled = build(spark, FACTS, areas=((1, "x"), (2, "z")))
    assert sorted(tuple(r) for r in context.cells_to_rescore(base, relabelled, KEYS).collect()) == [(2, 1), (2, 3)]
    assert context.cells_to_rescore(base, build(spark, FACTS), KEYS).collect() == []
    assert context.cells_to_rescore(base.where("false"), base, KEYS).count() == 4


def test_values_do_not_run_into_each_other_and_nothing_is_a_hash_too(spark):
    a, b = (as_dict(build(spark, [(1, 1, n, None), (1, 2, m, None)]))[1, 1] for n, m in (("xy", "z"), ("x", "z")))
    assert a != b
    empty = as_dict(build(spark, FACTS, areas=()))[2, 3]
    assert empty == hashlib.sha256(b"/").hexdigest()
    one = spark.createDataFrame([("p" + context.BETWEEN, 1)], "v string, k int").select(F.sha2(context.row_text(["v"]), 256)).first()[0]
    assert one == hashlib.sha256(("p" + context.BETWEEN).encode()).hexdigest()
