"""Parquet scans and sinks of the register and the unit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import qcol

REGISTER_VIEW = "master_aset"


def read_register(spark: SparkSession, path: str, view: str | None = REGISTER_VIEW) -> DataFrame:
    """Scan the register, its fixed columns in front in their order (folder
    columns are read back last), and (optionally) expose it as a SQL view."""
    df = spark.read.parquet(path)
    fixed = [c for c in K.FIXED_COLUMNS if c in df.columns]
    df = df.select(*fixed, *[qcol(c) for c in df.columns if c not in fixed])
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_detail(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_register(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_within: Sequence[str] = (),
                   mode: str = "overwrite") -> None:
    """Snappy Parquet (min/max statistics are written by default).

    With ``partition_by`` the folders allow partition pruning; a folder's rows
    are clustered by ``sort_within``: each file holds a range of them, sorted,
    so that readers skip files and row groups by their statistics.  There are as
    many ranges as shuffle partitions; they end with a hash of the row, so a folder or a cluster key that holds most
    rows is dealt over many tasks and files.  Without ``sort_within`` rows are
    rebalanced by the folder columns."""
    out = df
    if sort_within:
        keys = [qcol(c) for c in [*partition_by, *sort_within]]
        spread = F.xxhash64(*[qcol(c) for c in df.columns])
        # A stated number of ranges: without one, small neighbours are merged.
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.repartitionByRange(ranges, *keys, spread).sortWithinPartitions(*keys)
    elif partition_by:
        out = out.hint("rebalance", *partition_by)
    w = out.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
