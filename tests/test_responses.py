"""Model answers as they come: drafts, fences, second arrays, nested objects, cut-off ends."""
import pytest

from lodegrid.operators import runs

CASES = [
    ('Draft: [{"cell_id":"c1","score":0.1}]\n```json\n[{"cell_id":"c1","score":0.9}]\n```', [("c1", "0.9")]),
    ('```\n[{"cell_id":"c1","score":0.9}', [("c1", "0.9")]),
    ('[{"cell_id":"c1","score":0.5}] or [{"cell_id":"c1","score":0.6},{"cell_id":"c2"}]', [("c1", "0.5")]),
    ('[{"cell_id":"c1","score":1,"evidence":[{"a":{"b":{"cell_id":"c7","d":[{}]}}}]},{"cell_id":"c2","score":2}]', [("c1", "1"), ("c2", "2")]),
    ('[{"cell_id":"c1","evidence":"a } ] { \\" [ b"},{"cell_id":"c2"},{"cell_id":"c3","evid', [("c1", None), ("c2", None)]),
    ('{"cells":[{"batch":{"cell_id":"c4","score":0.4}},{"cell_id":"c5"}],"more":[{"cell_id":"c6"}]}', [("c4", "0.4"), ("c5", None)]),
    ('[] nothing, but {"cell_id":"c1"}', []),
    ('{"cell_id":"c1","score":1}', []),
    ("no brackets at all", []), ("", []), (None, []), ("]]}}[[{{", []), ('["a", 1, null, {"x": 1}]', []),
    ('[{"cell_id":"c1","score":"0.7"},\n {"cell_id":"c1","score":0.8}]', [("c1", "0.7"), ("c1", "0.8")]),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, body string")
    out = {}
    for r in runs.parse_responses(df, "body", ["i"]).orderBy("i", "position").collect():
        out.setdefault(r.i, []).append((r.cell_id, r.score))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_items_of_an_answer(parsed, i):
    assert parsed.get(i, []) == CASES[i][1]


def test_first_mention_counts_and_values_are_clamped(spark):
    text = '[{"cell_id":"c1","score":7,"confidence":"x","evidence":["a",{"b":1}]},{"cell_id":"w-1","score":0.2},{"cell_id":"c2","evidence":"one"}]'
    items = runs.parse_responses(spark.createDataFrame([(1, text)], "b int, t string"), "t", ["b"])
    cells = spark.createDataFrame([(1, "c1", "w-1"), (1, "c2", "w-2"), (1, "c3", "w-3")], "b int, label string, cell_id string")
    got = sorted((r.cell_id, r.score, r.confidence, r.evidence) for r in runs.scored_from_items(items, cells, ["b"]).collect())
    assert got == [("w-1", 1.0, 0.5, ["a", '{"b":1}']), ("w-2", 0.0, 0.5, ["one"])]
