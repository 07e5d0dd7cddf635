"""Streaming forms of the ingestion and usage jobs; the transformations are the batch functions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodegrid.operators.runs import usage_rollup
from lodegrid.sinks.tablelog import TableLog
from lodegrid.sources.normalize import FIELDS, NORMALIZERS

CALLS = "event_id bigint, ts timestamp, run_id bigint, agent_id string, input_tokens bigint, output_tokens bigint"


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CALLS).json(path)


def windowed_usage(calls: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls, tokens and cost per window, run and agent; repeats of an event inside the watermark count once."""
    if calls.isStreaming:
        calls = calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        calls = calls.dropDuplicates(["event_id"])
    windowed = calls.withColumn("window", F.window("ts", width))
    out = usage_rollup(windowed, ["window", "run_id", "agent_id"])
    return out.select(F.col("window.start").alias("window_start"), "run_id", "agent_id", "calls", "input_tokens", "output_tokens", "est_cost_usd")


EVENTS = "event_id bigint, ts timestamp, run_id bigint, phase string, status string, cells bigint, tokens bigint"


def read_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Run events as they land; ``files`` bounds the files of a batch."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def run_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", last_phase: str = "complete") -> DataFrame:
    """Life cycle of runs: a run's events that follow each other within ``gap`` are one session.

    Batches, their parse states, cells and tokens, the last phase, and whether the session ended: ``complete`` if its last phase
    says so, else ``expired``, as nothing came for a whole gap. The same function serves a batch and a stream; a stream
    gives a session once the watermark has passed its end, and forgets it. Repeats of an event count once.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        events = events.dropDuplicates(["event_id"])
    last = F.max(F.struct("ts", "event_id", "phase"))
    out = events.groupBy(F.session_window("ts", gap).alias("session"), "run_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"), F.count("*").alias("events"),
        F.count_if(F.col("status").isNotNull()).alias("batches"), *[F.count_if(F.col("status") == k).alias(k) for k in ("ok", "partial", "failed")],
        F.coalesce(F.sum("cells"), F.lit(0)).alias("cells_scored"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), last.alias("_l"))
    phase = F.col("_l.phase")
    return out.select(
        "run_id", "started_at", "last_event_at", "events", "batches", "ok", "partial", "failed", "cells_scored", "tokens", phase.alias("last_phase"),
        F.when(phase == last_phase, "complete").otherwise("expired").alias("state"))


FEATURE_SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS.items()) + ", ingested_at timestamp"


def feature_table(spark: SparkSession, path: str) -> TableLog:
    """Features of all channels, one row per record of a channel, the newest landed."""
    return TableLog(spark, path, FEATURE_SCHEMA, ["source_channel", "source_record_id"], ["ingested_at"], "source_channel")


def sync_channel(spark: SparkSession, landed: str, channel: str, schema: str, table: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Normalise newly landed files of a channel and merge them into the feature table, then stop.

    Within a batch the file landed last wins. The table remembers the last batch of each channel, so one that is
    replayed after a failure is not merged again. ``files`` bounds the files of a batch.
    """
    reader = spark.readStream.schema(schema)
    raw = (reader.option("maxFilesPerTrigger", files) if files else reader).json(landed).withColumn("ingested_at", F.col("_metadata.file_modification_time"))

    def merge(batch: DataFrame, number: int) -> None:
        features = NORMALIZERS[channel](batch, channel).where("source_record_id <> ''")
        feature_table(batch.sparkSession, table).merge(features, (channel, number))

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
