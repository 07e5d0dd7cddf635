"""Commits, crashes between writes, compaction and replays of the table log."""
import pytest
from pyspark.sql import functions as F

from lodegrid.sinks.tablelog import MOST_DELTAS, TableLog

SCHEMA = "ch string, k int, v int, text string"


@pytest.fixture
def log(spark, tmp_path):
    return TableLog(spark, str(tmp_path / "t"), SCHEMA, ["ch", "k"], ["v"], "ch")


def put(log, *rows, **more):
    log.merge(log.spark.createDataFrame(list(rows), SCHEMA), **more)


def rows(df):
    return sorted((r.ch, r.k, r.text) for r in df.collect())


def data_files(log):
    import pathlib
    return sorted(p.name for p in pathlib.Path(log.path, "data").iterdir() if p.name[0] == "v")


def test_late_rows_take_nothing_back_and_equal_ones_give_way(log):
    assert rows(log.read()) == []
    put(log, ("a", 1, 5, "new"), ("b", 1, 1, "b"), ("b", 1, 0, "older in the batch"))
    put(log, ("a", 1, 3, "late"), ("a", 2, 1, "two"), ("b", 1, 1, "same age"))
    assert rows(log.read()) == [("a", 1, "new"), ("a", 2, "two"), ("b", 1, "same age")]
    assert rows(log.read(["b"])) == [("b", 1, "same age")]
    assert log.current().version == 2


def test_a_crash_between_any_two_writes_leaves_the_last_version(log, monkeypatch):
    put(log, ("a", 1, 1, "one"))
    log.publish(log.read(), {"state": "first"})
    kept = rows(log.read()), [tuple(r) for r in log.meta().collect()]

    def lost(_):
        raise RuntimeError("lost")

    monkeypatch.setattr(log, "_commit", lost)
    for change in (lambda: put(log, ("a", 1, 9, "never")), lambda: log.publish(log.read().limit(0), {"state": "never"})):
        with pytest.raises(RuntimeError):
            change()
        assert (rows(log.read()), [tuple(r) for r in log.meta().collect()]) == kept
    monkeypatch.undo()
    put(log, ("a", 2, 1, "two"))
    assert rows(log.read()) == [("a", 1, "one"), ("a", 2, "two")]
    assert log.vacuum() >= 2 and rows(log.read()) == [("a", 1, "one"), ("a", 2, "two")]
    assert set(data_files(log)) >= log.current().files()


def test_a_lost_compaction_changes_nothing(log, monkeypatch):
    for i in range(3):
        put(log, ("a", i, 1, str(i)))
    commit = log._commit
    monkeypatch.setattr(log, "_commit", lambda m: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.compact()
    monkeypatch.setattr(log, "_commit", commit)
    assert len(log.current().deltas) == 3 and len(rows(log.read())) == 3
    log.compact()
    assert not log.current().deltas and len(rows(log.read())) == 3


def test_files_and_deltas_stay_bounded_and_untouched_parts_are_not_rewritten(log):
    put(log, ("z", 0, 0, "still"))
    log.compact()
    still = log.current().base["pz"]
    for i in range(2 * MOST_DELTAS + 5):
        put(log, ("a", i % 4, i, str(i)))
        assert len(log.current().deltas) <= MOST_DELTAS
    assert log.current().base["pz"] == still
    n = 2 * MOST_DELTAS + 5
    assert rows(log.read()) == [("a", k, str(max(i for i in range(n) if i % 4 == k))) for k in range(4)] + [("z", 0, "still")]
    log.compact()
    log.vacuum()
    assert len(data_files(log)) <= 2 + MOST_DELTAS + 1
    assert len(rows(log.read())) == 5


def test_replayed_batches_do_nothing(log):
    put(log, ("a", 1, 1, "one"), batch=("src", 0))
    put(log, ("a", 1, 1, "replayed"), batch=("src", 0))
    put(log, ("a", 1, 1, "other source"), batch=("other", 0))
    put(log, ("a", 2, 1, "two"), batch=("src", 1))
    assert rows(log.read()) == [("a", 1, "other source"), ("a", 2, "two")]


def test_tables_without_a_part_column_and_odd_parts(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "h"), "k int, v int", ["k"], ["v"])
    log.merge(spark.range(100).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v")))
    log.merge(spark.range(50).select(F.col("id").cast("int").alias("k"), F.lit(2).alias("v")))
    log.merge(spark.createDataFrame([], "k int, v int"))
    assert log.read().groupBy("v").count().orderBy("v").collect() == [(1, 50), (2, 50)]
    odd = TableLog(spark, str(tmp_path / "o"), SCHEMA, ["ch", "k"], ["v"], "ch")
    put(odd, ("a/b=c, d", 1, 1, "x"), (None, 1, 1, "y"), ("", 1, 1, "z"))
    odd.compact()
    assert sorted(r.text for r in odd.read().collect()) == ["x", "y", "z"]
    assert [r.text for r in odd.read([None]).collect()] == ["y"] and [r.text for r in odd.read([""]).collect()] == ["z"]
