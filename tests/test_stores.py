"""The snapshot store and the clustered register store."""

import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assetlens.sources.parquet import read_register, write_register
from assetlens.sources.snapshots import SnapshotStore, latest_good_snapshot, needed_loads

START = datetime(2026, 1, 1)


def _loads(spark, rows):
    return spark.createDataFrame([(s, START + timedelta(hours=h), ok, d) for s, h, ok, d in rows],
                                 SnapshotStore.SCHEMA)


def _status(df):
    return {r["sheet"]: (r["source"], r["data"]) for r in df.collect()}


def test_store_equals_a_full_history(spark, tmp_dir):
    """However loads are split into appends, a snapshot equals that of the
    whole history; a read touches the base and few deltas."""
    rng = random.Random(1)
    store = SnapshotStore(spark, tmp_dir + "/store", max_deltas=3)
    assert store.snapshot().count() == 0
    history = []
    for batch in range(9):
        rows = [(rng.choice(["K1", "K2", "Capaian", "IGT"]), rng.randrange(1000), rng.random() < 0.4, f"d{batch}-{i}")
                for i in range(rng.randrange(5))]
        history += rows
        store.append(_loads(spark, rows), batch)
        assert len(store._folders(store.manifest())) <= 4
    assert _status(store.snapshot()) == _status(latest_good_snapshot(_loads(spark, history)))
    before = store.manifest()["version"]
    assert store.append(_loads(spark, [("K9", 1, True, "again")]), 8) == before  # a replayed batch
    assert store.compact() == store.manifest()["version"] == (before + 1 if store.manifest(before)["deltas"] else before)
    assert store.manifest()["deltas"] == []
    assert _status(store.snapshot()) == _status(latest_good_snapshot(_loads(spark, history)))


def test_readers_keep_their_version(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir + "/store", max_deltas=2)
    first = store.append(_loads(spark, [("K1", 1, True, "old")]))
    reader = store.snapshot()
    # folders without a manifest, as a writer leaves them that dies half-way
    needed_loads(_loads(spark, [("K1", 9, True, "lost")])).write.parquet(f"{store.path}/delta/dead")
    assert _status(SnapshotStore(spark, store.path).snapshot()) == {"K1": ("live", "old")}
    for hour in (2, 3, 4):
        store.append(_loads(spark, [("K1", hour, hour != 4, f"v{hour}")]))
    assert _status(reader) == {"K1": ("live", "old")} == _status(store.snapshot(version=first))
    assert _status(store.snapshot()) == {"K1": ("cache", "v3")}
    store.vacuum(keep=1)
    assert len(store.versions()) == 1 and "dead" not in store._names("delta")
    assert _status(store.snapshot()) == {"K1": ("cache", "v3")}


def test_second_writer_of_a_version_fails(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir + "/store")
    store.append(_loads(spark, [("K1", 1, True, "a")]))
    with pytest.raises(RuntimeError):
        store._commit({"version": 0, "base": None, "deltas": [], "batch": None})


def test_base_holds_two_loads_a_tab_at_most(spark):
    rows = [("K1", h, h % 3 == 0, str(h)) for h in range(50)] + [("K2", 1, False, "x"), ("K2", 1, False, "x")]
    kept = sorted((r["sheet"], r["ok"], r["data"]) for r in needed_loads(_loads(spark, rows)).collect())
    assert kept == [("K1", False, "49"), ("K1", True, "48"), ("K2", False, "x")]


def test_register_store_skips_files_of_other_units(spark, tmp_dir):
    """A unit's rows of a class lie in few files, found by their statistics,
    though one unit holds half of all rows."""
    out = tmp_dir + "/register"
    rows = spark.range(40_000).selectExpr(
        "id AS nomor", "'A' AS jenis_bmn", "CAST(id AS string) AS kode_satker",
        "concat('Unit ', lpad(IF(id % 2 = 0, 500, id % 1000), 4, '0')) AS nama_satker", "CAST(id AS string) AS kode_barang",
        "id AS nup", "IF(id % 8 = 1, 'TANAH', 'MESIN') AS golongan_bmn")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "24")
    try:
        write_register(rows, out, ["golongan_bmn"], ["nama_satker"])
    finally:
        spark.conf.set(key, before)
    groups = []
    for path in [r[0] for r in spark.read.parquet(out).select("_metadata.file_path").distinct().collect()]:
        meta = pq.ParquetFile(path.removeprefix("file://").removeprefix("file:")).metadata
        place = meta.schema.names.index("nama_satker")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(place).statistics
            groups.append((stats.min, stats.max, meta.row_group(g).num_rows))
    # half of the rows are one unit's: no file holds more than a share of them
    assert max(n for *_, n in groups) < 40_000 / 8
    holding = [n for low, high, n in groups if low <= "Unit 0111" <= high]
    assert holding and sum(holding) < 40_000 / 6, holding
    back = read_register(spark, out, view=None).filter(F.col("nama_satker") == "Unit 0111")
    assert back.count() == rows.filter("nama_satker = 'Unit 0111'").count()
    assert "EqualTo(nama_satker,Unit 0111)" in back._jdf.queryExecution().executedPlan().toString()
