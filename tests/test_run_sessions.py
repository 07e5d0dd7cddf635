"""Run sessions by hand: a gap parts two sessions, repeats count once, and an open session waits for the watermark."""
from datetime import datetime, timedelta

from lodegrid.streaming.pipelines import EVENTS, read_events, run_sessions

START = datetime(2024, 1, 1, 12)


def event(i, minutes, run, phase="batch", status=None, cells=None, tokens=None):
    return (i, START + timedelta(minutes=minutes), run, phase, status, cells, tokens)


ROWS = [event(1, 0, 1, "start"), event(2, 10, 1, status="ok", cells=50, tokens=10), event(3, 25, 1, status="partial", cells=20), event(3, 25, 1, status="partial", cells=20),
        event(4, 40, 1, "complete"), event(5, 120, 1, "start"), event(6, 130, 1, status="failed"), event(7, 5, 2, "start")]
WANT = [(1, 0, 40, 4, 2, 1, 1, 0, 70, 10, "complete", "complete"), (1, 120, 130, 2, 1, 0, 0, 1, 0, 0, "batch", "expired"), (2, 5, 5, 1, 0, 0, 0, 0, 0, 0, "start", "expired")]


def plain(rows):
    minutes = lambda t: int((t - START).total_seconds() // 60)
    return sorted((r.run_id, minutes(r.started_at), minutes(r.last_event_at), *r[3:]) for r in rows)


def test_sessions_of_a_batch(spark):
    assert plain(run_sessions(spark.createDataFrame(ROWS, EVENTS)).collect()) == WANT


def test_a_stream_gives_a_session_when_its_gap_has_passed(spark, tmp_path):
    landed, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def land(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(landed)
        stream = run_sessions(read_events(spark, landed), late="10 minutes")
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
        return plain(spark.read.schema(stream.schema).parquet(out).collect())

    assert land(ROWS[:5]) == []
    assert land(ROWS[5:7]) == [WANT[0]]  # minute 130 less 10 is past minute 40 and its gap
    assert land([ROWS[7]]) == [WANT[0]]  # too late: the watermark has passed it
    assert land([event(9, 400, 3, "start")]) == WANT[:2]
