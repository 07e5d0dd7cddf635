import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodegrid.functions import scalars as sc
from lodegrid.operators import pins, records, runs
from lodegrid.plans import raster_build
from lodegrid.session import scratch_path
from lodegrid.sinks import tables as sink
from lodegrid.sources import rasters, tracks
from lodegrid.streaming import pipelines

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>Map</name>
<Folder><name>Adits</name><Placemark><name>One</name><Point><coordinates>-121.5,48.1,0</coordinates></Point></Placemark>
<Placemark><name>Road</name><LineString><coordinates>0,0 1,1</coordinates></LineString></Placemark>
<Folder><name>Deep</name><Placemark><name>Two</name><description>shaft</description><Point><coordinates>-121.6,48.2</coordinates></Point></Placemark></Folder></Folder>
<Placemark><name>Three</name><TimeStamp><when>2025-09-14T17:02:00Z</when></TimeStamp><Point><coordinates>-121.7,48.3</coordinates></Point></Placemark></Document></kml>"""


def test_kml_folders_and_skips(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    marks = tracks.read_kml(spark, str(tmp_path / "a.kml"))
    got = {r.name: (r.folder, r.date) for r in tracks.kml_points(marks, ["source_file"]).collect()}
    assert got == {"One": ("Adits", None), "Two": ("Deep", None), "Three": ("", "2025-09-14")}
    assert [(r.kind, r["count"]) for r in tracks.kml_skipped(marks, ["source_file"]).collect()] == [("LineString", 1)]


def test_kmz_reads_every_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("doc.kml", KML)
        z.writestr("other/more.KML", KML.replace("One", "Uno"))
        z.writestr("readme.txt", "no")
    names = [r.name for r in tracks.kml_points(tracks.read_kmz(spark, str(tmp_path / "b.kmz")), ["source_file"]).collect()]
    assert sorted(names) == ["One", "Three", "Three", "Two", "Two", "Uno"]


def raster_text(rows, vat, declared=None):
    head = "EXP  0 T.E00\nGRD  2\n         4         3 1-0.21474836470000E+10\n 0.5E+02 0.5E+02\n 0.4E+06 0.535E+07\n 0.4002E+06 0.535015E+07\n"
    body = "\n".join(" ".join(str(v) for v in r + [-1]) for r in rows)
    lines = "\n".join(f"{v:11d}{n:11d}{label}" for v, n, label in vat)
    return f"{head}{body}\nEOG\nIFO  2\nT.VAT                XX   3   3  22 {declared or len(vat):9d}\nVALUE   4-1\nCOUNT  4-1\nLABEL  4-1\n{lines}\nEOI\n".encode()


ROWS = [[1, 1, 2, 2], [1, 1, 2, 9], [2, 3, 3, 3]]
VAT = [(1, 4, "Evsf"), (2, 4, "Eck"), (3, 3, "Kigd")]


def test_raster_rows_padding_and_counts(spark, tmp_path):
    (tmp_path / "geol.e00").write_bytes(raster_text(ROWS, VAT))
    px, attrs = rasters.read_rasters(spark, str(tmp_path))
    got = {(r.col, r.row): (r.value, r.x, r.y) for r in px.collect()}
    assert len(got) == 11 and (3, 1) not in got  # 9 is not declared
    assert got[(0, 0)] == (1, 400025.0, 5350125.0) and got[(3, 2)] == (3, 400175.0, 5350025.0)
    assert rasters.count_mismatches(px, attrs).isEmpty()
    cells = raster_build.native_cells(px, attrs, {"geol": "geol", "fault": "none", "fold": "none", "dike": "none"})
    assert cells.agg(F.count("*")).first()[0] >= 1 and {r.geol_unit for r in cells.collect()} <= {"Evsf", "Eck", "Kigd"}


def test_a_value_table_without_records_declares_nothing(spark, tmp_path):
    text = raster_text(ROWS, [])
    (tmp_path / "none.e00").write_bytes(text)
    px, attrs = rasters.read_rasters(spark, str(tmp_path))
    assert px.isEmpty() and attrs.isEmpty()
    (tmp_path / "none.e00").write_bytes(text[:text.index(b"IFO")] + b"EOI\n")  # no table at all: every pixel counts
    assert rasters.read_rasters(spark, str(tmp_path))[0].count() == 12


@pytest.mark.parametrize("text", [raster_text(ROWS[:2], VAT), raster_text(ROWS, VAT, declared=5)])
def test_raster_mismatch_fails(spark, tmp_path, text):
    (tmp_path / "bad.e00").write_bytes(text)
    px, attrs = rasters.read_rasters(spark, str(tmp_path))
    with pytest.raises(Exception):
        px.count() and attrs.count()


def test_pin_ids_stay_unique(spark):
    df = spark.createDataFrame([(i, n, "f") for i, n in enumerate(["Gold Adit", "Gold  Adit", "gold-adit", "", "Émile's"])], "ord int, name string, source_file string")
    assert [r.pin_id for r in pins.assign_ids(df, "ord").orderBy("ord").collect()] == ["gold-adit", "gold-adit-2", "gold-adit-3", "pin-4", "emile-s"]


def test_unknown_role_stops_the_import(spark):
    p = spark.createDataFrame([("a", "A")], "pin_id string, name string")
    notes = spark.createDataFrame([("a", "", "evidnce", "", "", "", "", "", "")], "pin_id string, name string, role string, provenance string, visited string, observed string, position_confidence string, date string, source_note string")
    with pytest.raises(Exception, match="not allowed"):
        pins.annotate(p, notes, {"role": "display", "provenance": "unknown", "position_confidence": "rough"}).collect()


def test_truth_pins_are_hidden_by_default(spark):
    p = spark.createDataFrame([("a", "truth"), ("b", "evidence"), ("c", "evidence "), ("d", "typo")], "id string, role string")
    assert {r.id for r in records.visible_pins(p).collect()} == {"b", "c"}
    assert {r.id for r in records.visible_pins(p, ("display",)).collect()} == {"d"}


def test_secrets_are_never_written(spark, tmp_path):
    df = spark.createDataFrame([("r", "2026-01-01", ("k",))], "run_id string, created_at string, inputs struct<api_key:string>")
    with pytest.raises(ValueError, match="inputs.api_key"):
        sink.write_runs(df, str(tmp_path / "runs"))


@pytest.mark.parametrize("text,n", [
    ('```json\n[{"cell_id":"c1","score":0.7,"confidence":2,"evidence":["a"]},{"cell_id":"c1","score":0.1}]\n``` bye', 1),
    ('prose [{"cell_id":"c1","score":"x"},{"cell_id":"c2","score":0.2}] more prose', 2),
    ('[{"cell_id":"c1","score":0.7},{"cell_id":"c2","sco', 1), ("I cannot do that.", 0)])
def test_response_repair(spark, text, n):
    df = spark.createDataFrame([(1, text)], "batch int, text string")
    cells = spark.createDataFrame([(1, "c1", "id1"), (1, "c2", "id2")], "batch int, label string, cell_id string")
    got = runs.scored_from_items(runs.parse_responses(df, "text", ["batch"]), cells, ["batch"]).orderBy("cell_id").collect()
    assert len(got) == n
    if n == 1 and "```" in text:
        assert (got[0].score, got[0].confidence, got[0].evidence) == (0.7, 1.0, ["a"])


def test_batches_of_fifty(spark):
    df = spark.range(120).select(F.lit("g").alias("aoi"), F.col("id").alias("k"))
    out = runs.batches(df, ["aoi"], ["k"]).orderBy("k").collect()
    assert [r.batch for r in out] == [i // 50 for i in range(120)] and out[49].label == "c50" and out[50].label == "c1"


def test_channel_sync_upserts_incrementally(spark, tmp_path):
    landed, table, ck = (str(tmp_path / n) for n in ("landed", "table", "ck"))
    schema = "id bigint, name string, latitude string, longitude string"
    rows = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").json(landed)
    rows((1, "a", "47", "-121"), (2, "b", "47", "-121"))
    pipelines.sync_channel(spark, landed, "mindat", schema, table, ck).awaitTermination()
    rows((2, "b2", "47", "-121"), (3, "c", "bad", "-121"))
    pipelines.sync_channel(spark, landed, "mindat", schema, table, ck).awaitTermination()
    got = {r.source_record_id: r.name for r in pipelines.feature_table(spark, table).read().collect()}
    assert got == {"1": "a", "2": "b2"}


def test_unchanged_features_are_not_rewritten(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, f string")
    path = str(tmp_path / "out")
    assert sink.write_features(df, "f", ["k"], path) and not sink.write_features(df.repartition(3), "f", ["k"], path)
    assert sink.write_features(df.where("k = 1"), "f", ["k"], path)


def test_ids_that_meet_at_second_and_third_order(spark):
    names = ["a", "a", "a-2", "a-2-3", "a-2-3"]
    df = spark.createDataFrame([("f", i, n, 1.5) for i, n in enumerate(names)] + [("g", 0, "a", 2.5)], "source_file string, ord int, name string, lon double")
    got = pins.assign_ids(df, "ord").orderBy("source_file", "ord").collect()
    assert [r.pin_id for r in got] == ["a", "a-2", "a-2-2", "a-2-3", "a-2-3-2", "a"]
    assert got[0].lon == 1.5 and got[5].lon == 2.5


def test_slugs_keep_the_letters_under_marks(spark):
    words = ["\u0160koda \u0141\u00f3d\u017a \u0150 \u00f1", "\ufb01ne \u2460 \uff21\uff22", "--x--", "\u4e2d", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    assert [r[0] for r in df.orderBy("i").select(sc.slug(F.col("w"))).collect()] == ["skoda-odz-o-n", "fine-1-ab", "x", "", ""]
    names = ["Report  (A)_1.PDF", "a.b c.pdf", "_x-", "...", ".pdf"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(names)], "i int, w string")
    assert [r[0] for r in df.orderBy("i").select(sc.document_slug(F.col("w"))).collect()] == ["report-a-1", "ab-c", "-x-", "untitled", "untitled"]


def test_the_last_annotation_of_a_pin_holds(spark):
    p = spark.createDataFrame([("p1", "One")], "pin_id string, name string")
    fields = ["role", "provenance", "visited", "observed", "position_confidence", "date", "source_note"]
    rows = [(i, "p1", "", "", "", "", text, "", "", "") for i, text in enumerate(["first", "second", "last"])]
    notes = spark.createDataFrame(rows, "at int, pin_id string, name string, " + ", ".join(f"{f} string" for f in fields))
    defaults = {"role": "display", "provenance": "unknown", "position_confidence": "rough"}
    assert pins.annotate(p, notes, defaults).first().observed == "last"
    assert pins.annotate(p, notes.withColumn("at", -F.col("at")), defaults, order="at").first().observed == "first"


def test_new_sites_need_a_visit_and_a_look(spark):
    p = spark.createDataFrame([("a", "field_visit"), ("b", "unknown"), ("c", "field_visit")], "pin_id string, provenance string")
    near = spark.createDataFrame([("a", 0.20004, "x"), ("b", 5.0, "y"), ("c", None, None)], "pin_id string, nearest_km double, nearest_name string")
    got = {r.pin_id: (r.nearest_db_km, r.nearest_db_name, r.potentially_new) for r in pins.flag_new_sites(p, near).collect()}
    assert got == {"a": (0.2, "x", True), "b": (5.0, "y", False), "c": (None, None, False)}


def test_pasted_positions(spark):
    texts = ["48.5, -121.25", "-121.25 48.5", "48\u00b0 30' N 121\u00b0 15' W", "48 30 0 N, 121:15:0W", "48d 30m 0s N 121d 15m 0s W", "48.5 N", "somewhere", "1 2 3", "33\u00b030'0\"S 70\u00b015'E"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c and (r.c.lon, r.c.lat) for r in df.orderBy("i").select(sc.parse_coordinate(F.col("t")).alias("c")).collect()]
    assert got == [(-121.25, 48.5)] * 5 + [None] * 3 + [(70.25, -33.5)]


def test_objects_are_found_whatever_stands_around_them(spark):
    text = 'x {"cells": [{"cell_id": "c1", "score": 0.5, "evidence": ["a } b"]}, {"cell_id": "c2", "meta": {"k": 1}}]} then {"cell_id": "c3"'
    df = spark.createDataFrame([(1, text)], "batch int, body string")
    assert [r.cell_id for r in runs.parse_responses(df, "body", ["batch"]).orderBy("position").collect()] == ["c1", "c2"]
