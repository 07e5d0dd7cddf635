"""Pin ids against taking the first free one pin after pin."""
import random

import pytest

from lodegrid.operators import pins


def one_by_one(rows):
    used, out = set(), {}
    for f, i, name, carried in sorted(rows, key=lambda r: (r[0], r[1])):
        place = sum(1 for r in rows if r[0] == f and r[1] <= i)
        base = carried.strip() if carried and carried.strip() else name or f"pin-{place}"
        n, pid = 1, base
        while (f, pid) in used:
            n += 1
            pid = f"{base}-{n}"
        used.add((f, pid))
        out[f, i] = pid
    return out


def assigned(spark, rows):
    df = spark.createDataFrame(rows, "source_file string, ord int, name string, pin_id string")
    return {(r.source_file, r.ord): r.pin_id for r in pins.assign_ids(df, "ord").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_ids_match_taking_the_first_free_one(spark, seed):
    rng = random.Random(seed)
    names = ["a", "a", "a", "a-2", "a-3", "a-2-2", "a-10", "b", "b-1", "b-02", "", "pin-3", "pin-3-2"]
    rows = [(f"f{rng.randrange(3)}", i, rng.choice(names), rng.choice([None, None, None, "", "a", "a-4", "x-2"])) for i in range(150)]
    assert assigned(spark, rows) == one_by_one(rows)


def test_a_file_of_equal_names(spark):
    rows = [("f", i, "same name", None) for i in range(400)]
    got = assigned(spark, rows)
    assert got["f", 0] == "same-name" and got["f", 1] == "same-name-2" and got["f", 399] == "same-name-400"


def test_the_plan_has_no_python(spark):
    df = spark.createDataFrame([("f", 1, "a", None)], "source_file string, ord int, name string, pin_id string")
    plan = pins.assign_ids(df, "ord")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
