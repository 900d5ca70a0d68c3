"""Continuous ingest of landed tab payloads.

Payload files dropped into a landing folder are parsed as they arrive and
folded into the per-tab load status (live / cache / failed with the last
good table), kept in a snapshot store or as streaming aggregation state.  The
file source records processed files in the checkpoint, so a restarted query
(or a lost executor) resumes without reprocessing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..sources.payloads import parse_payloads, sheet_of_file
from ..sources.snapshots import SnapshotStore, latest_good_snapshot


def payload_stream(spark: SparkSession, landing_dir: str, glob: str = "*.json",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (sheet, ts, ok, error, data) - one row per landed payload,
    ``ts`` being the file's modification time and ``data`` the table as
    JSON text."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(landing_dir)
    texts = raw.select(
        sheet_of_file(F.col("_metadata.file_name")).alias("sheet"),
        F.col("_metadata.file_modification_time").alias("ts"),
        F.col("value").alias("text"))
    parsed = parse_payloads(texts, keep=["ts"])
    return parsed.select("sheet", "ts", "ok", "error", F.to_json(F.col("table")).alias("data"))


def status_stream(payloads: DataFrame, no_cache: Sequence[str] = K.NO_CACHE_SHEETS) -> DataFrame:
    """Per-tab load status as a streaming aggregation (complete/update mode)."""
    return latest_good_snapshot(payloads, no_cache=no_cache)


def start_status_query(spark: SparkSession, landing_dir: str, checkpoint: str, sink: str | None = None,
                       query_name: str = "tab_status", no_cache: Sequence[str] = K.NO_CACHE_SHEETS,
                       trigger_seconds: int | None = None, max_deltas: int = 50) -> StreamingQuery:
    """Run the status stream.  With ``sink`` each micro-batch appends its loads
    to the snapshot store under that (shared) path: a batch carries the tabs
    that landed, not all, a replayed batch adds nothing, and ``read_status``
    meets whole versions only.  Without it the status is kept as streaming
    aggregation state, in an in-memory table named ``query_name`` (tests)."""
    payloads = payload_stream(spark, landing_dir)
    if sink:
        store = SnapshotStore(spark, sink, max_deltas)

        def write(batch: DataFrame, epoch: int) -> None:
            store.append(batch, epoch)
            store.vacuum()
        w = payloads.writeStream.foreachBatch(write)
    else:
        w = status_stream(payloads, no_cache).writeStream.outputMode("complete").format("memory")
    w = w.option("checkpointLocation", checkpoint).queryName(query_name)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def read_status(spark: SparkSession, sink: str, no_cache: Sequence[str] = K.NO_CACHE_SHEETS) -> DataFrame:
    """The status by the latest version of the store."""
    return SnapshotStore(spark, sink).snapshot(no_cache)
