"""Load history of spreadsheet tabs: the last good copy per tab and a load
report.

A load attempt is a row (sheet, ts, ok, data).  The current state of a tab
is its latest attempt: live when that attempt succeeded; otherwise the data
of the latest successful attempt ("cache") unless the tab is never served
from a stored copy; otherwise failed.  Aggregates are ``max_by`` per tab, so
a tab with a very long history still costs one partial row per task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def latest_good_snapshot(loads: DataFrame, no_cache: Sequence[str] = K.NO_CACHE_SHEETS,
                         sheet_col: str = "sheet", ts_col: str = "ts", ok_col: str = "ok",
                         data_col: str = "data", tiebreak_col: str | None = None) -> DataFrame:
    """(sheet, source, data, data_ts, error_ts) per tab; source is 'live',
    'cache' or 'failed'."""
    order = F.struct(F.col(ts_col), F.col(tiebreak_col)) if tiebreak_col else F.col(ts_col)
    latest = F.max_by(F.struct(F.col(ok_col).alias("ok"), F.col(data_col).alias("data"), F.col(ts_col).alias("ts")),
                      order)
    # max_by ignores rows whose ordering value is NULL: only good loads count.
    good = F.max_by(F.struct(F.col(data_col).alias("data"), F.col(ts_col).alias("ts")), F.when(F.col(ok_col), order))
    agg = loads.groupBy(F.col(sheet_col).alias("sheet")).agg(latest.alias("cur"), good.alias("good"))
    cacheable = ~F.col("sheet").isin(list(no_cache)) if no_cache else F.lit(True)
    source = (F.when(F.col("cur.ok"), F.lit("live"))
              .when(cacheable & F.col("good").isNotNull(), F.lit("cache"))
              .otherwise(F.lit("failed")))
    data = (F.when(source == "live", F.col("cur.data")).when(source == "cache", F.col("good.data")))
    data_ts = (F.when(source == "live", F.col("cur.ts")).when(source == "cache", F.col("good.ts")))
    return agg.select("sheet", source.alias("source"), data.alias("data"), data_ts.alias("data_ts"),
                      F.when(~F.col("cur.ok"), F.col("cur.ts")).alias("error_ts"))


def load_report(status: DataFrame, with_names: bool = False) -> DataFrame:
    """Tabs per load outcome.  Names are listed only on request: they are
    one per tab, fine for a dashboard's six tabs but not for a table of
    millions of tabs."""
    aggs = [F.count(F.lit(1)).alias("jumlah")]
    if with_names:
        aggs.append(F.sort_array(F.collect_list("sheet")).alias("sheets"))
    return status.groupBy("source").agg(*aggs)


def needed_loads(loads: DataFrame) -> DataFrame:
    """Of all load attempts (sheet, ts, ok, data) the ones that later
    snapshots can need: each tab's latest and its latest good one."""
    row = F.struct("ts", "ok", "data")
    # The attempt itself breaks ties of time, so that any order of merging
    # keeps the same one.
    order = F.struct(F.col("ts"), F.col("ok"), F.col("data"))
    best = loads.groupBy("sheet").agg(F.max_by(row, order).alias("latest"),
                                      F.max_by(row, F.when(F.col("ok"), order)).alias("good"))
    kept = F.array_compact(F.array_distinct(F.array("latest", "good")))
    return best.select("sheet", F.inline(kept))


class SnapshotStore:
    """Versioned load history of tabs in a shared folder.

    A version is a small manifest that names the Parquet folders it consists
    of: a base, which holds the needed loads of all tabs, and the deltas
    appended since.  The manifest is written last, under its version number,
    and never changed, so a reader meets a whole version or the one before.
    ``append`` adds a delta; once there are ``max_deltas``, the next append
    merges base and deltas to a new base.  A read touches the base and the
    deltas after it, however many appends there were.

    One writer at a time: of two writers of one version the later fails.  A
    failed append leaves folders that no manifest names; ``vacuum`` deletes
    them and those of old versions."""

    SCHEMA = "sheet string, ts timestamp, ok boolean, data string"

    def __init__(self, spark: SparkSession, path: str, max_deltas: int = 50):
        self.spark, self.path, self.max_deltas = spark, path.rstrip("/"), max_deltas
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.root = self.hadoop.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.hadoop.Path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("log") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """Folders, last batch and number of a version (the latest one)."""
        versions = self.versions() if version is None else [version]
        if not versions:
            return {"version": -1, "base": None, "deltas": [], "batch": None}
        text = self.spark.read.text(f"{self.path}/log/{versions[-1]:020d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        name = f"{self.path}/log/{manifest['version']:020d}.json"
        if self.fs.exists(self.hadoop.Path(name)):
            raise RuntimeError(f"version {manifest['version']} exists: another writer was faster")
        draft = self.hadoop.Path(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode("utf-8")))
        out.close()
        if not self.fs.rename(draft, self.hadoop.Path(name)):
            raise RuntimeError(f"version {manifest['version']} exists: another writer was faster")
        return manifest["version"]

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def append(self, loads: DataFrame, batch: int | None = None) -> int:
        """Add load attempts; returns the version.  A ``batch`` number that the
        store has seen already adds nothing (streams replay batches)."""
        last = self.manifest()
        if batch is not None and last["batch"] is not None and batch <= last["batch"]:
            return last["version"]
        if len(last["deltas"]) >= self.max_deltas:
            last = self.manifest(self.compact())
        folder = f"delta/{uuid.uuid4().hex}"
        needed_loads(loads.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in self.SCHEMA.split(", "))])
                     ).write.parquet(f"{self.path}/{folder}")
        return self._commit({"version": last["version"] + 1, "base": last["base"], "deltas": [*last["deltas"], folder],
                             "batch": last["batch"] if batch is None else batch})

    def compact(self) -> int:
        """Merge base and deltas to a new base; returns the version."""
        last = self.manifest()
        if not last["deltas"]:
            return last["version"]
        folder = f"base/{uuid.uuid4().hex}"
        needed_loads(self._read(self._folders(last))).write.parquet(f"{self.path}/{folder}")
        return self._commit({"version": last["version"] + 1, "base": folder, "deltas": [], "batch": last["batch"]})

    @staticmethod
    def _folders(manifest: dict) -> list[str]:
        return [f for f in (manifest["base"], *manifest["deltas"]) if f]

    def loads(self, version: int | None = None) -> DataFrame:
        """The needed loads of a version; its folders stay as they are while
        later versions are written."""
        return self._read(self._folders(self.manifest(version)))

    def snapshot(self, no_cache: Sequence[str] = K.NO_CACHE_SHEETS, version: int | None = None) -> DataFrame:
        """``latest_good_snapshot`` of a version."""
        return latest_good_snapshot(needed_loads(self.loads(version)), no_cache)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and what they alone name."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {f for v in kept for f in self._folders(self.manifest(v))}
        for version in versions[:-keep]:
            self.fs.delete(self.hadoop.Path(f"{self.path}/log/{version:020d}.json"), False)
        for folder in ("base", "delta"):
            for name in self._names(folder):
                if f"{folder}/{name}" not in named:
                    self.fs.delete(self.hadoop.Path(f"{self.path}/{folder}/{name}"), True)


def append_loads(loads: DataFrame, path: str) -> None:
    """Append load attempts to the shared history table (partitioned by tab)."""
    loads.write.mode("append").partitionBy("sheet").parquet(path)
