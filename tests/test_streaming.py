"""Continuous tab-status ingest and the achievement dashboard job."""

import json
import os
import time

from assetlens.plans import jobs as J
from assetlens.sources import payloads as P
from assetlens.streaming.snapshots import read_status, start_status_query


def _payload(labels, rows):
    return "cb(" + json.dumps({"status": "ok", "table": {
        "cols": [{"id": chr(65 + i), "label": l} for i, l in enumerate(labels)],
        "rows": [{"c": [{"v": v} for v in r]} for r in rows]}}) + ");"


def _land(d, name, text, mtime):
    p = os.path.join(d, name + ".json")
    with open(p, "w") as f:
        f.write(text)
    os.utime(p, (mtime, mtime))


def test_status_stream(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    now = time.time()
    _land(landing, "K1", _payload(["Status Sertifikat"], [["selesai"]]), now - 100)
    _land(landing, "Capaian", "not json", now - 50)
    q = start_status_query(spark, landing, os.path.join(tmp_dir, "ckpt"), query_name="status_t1")
    try:
        q.processAllAvailable()
        got = {r["sheet"]: r["source"] for r in spark.sql("SELECT * FROM status_t1").collect()}
        assert got == {"K1": "live", "Capaian": "failed"}
        # a failed reload of K1 falls back to its last good copy
        _land(landing, "K1__2", "broken", now)
        q.processAllAvailable()
        rows = {r["sheet"]: r for r in spark.sql("SELECT * FROM status_t1").collect()}
        assert rows["K1"]["source"] == "cache" and "selesai" in rows["K1"]["data"]
    finally:
        q.stop()


def test_achievement_dashboard(spark):
    texts = [
        ("Capaian", _payload(["TOTAL CAPAIAN K1 NUP", "Bidang", "K2 NUP", "Bidang 2", "K3 NUP", "Bidang 3",
                              "K4 NUP", "Bidang 4", "JUMLAH KOMPONEN A Capaian", "% Capaian"],
                             [["1.000", "10", "2.000", "20", "3.000", "30", "0", "0", "60", "50,5%"],
                              ["9", "9", "9", "9", "9", "9", "9", "9", "9", "9"]])),
        ("K1", _payload(["No Urut", "Status Sertifikat"], [["1", "Selesai"], ["2", "Proses"]])),
        ("K2", _payload(["No Urut", "Status Sertifikat"], [["1", "Proses"]])),
        ("K3", _payload(["No Urut", "Permasalahan K3 2025", "Status Sertifikat"],
                        [["1", "Sengketa", "x"], ["2", "", "y"]])),
        ("IGT", _payload(["Kab Kota", "% Capaian IGT"], [["A", "87,5%"]])),
        ("ActionPlan", _payload(["Nama Kegiatan", "Langkah Kerja"], [["A", "1"], ["", "2"], ["B", "3"]])),
    ]
    parsed = P.parse_payloads(spark.createDataFrame(texts, "sheet string, text string"))
    dash = J.achievement_dashboard(spark, parsed, searches={"K1": "selesai"}, k3_problem="Sengketa")
    k = dash.kpis.first()
    assert (k["k1_nup"], k["k1_bidang"], k["total_bidang"], k["total_pct"], k["k1_percent"]) == (
        1000.0, 10.0, 60.0, "50,5%", 17)
    # With an overview row the summaries are its parcels, not the tabs' rows.
    summ = {r["name"]: (r["total"], r["percent"]) for r in dash.summaries.collect()}
    assert summ == {"K1": (10, 17), "K2": (20, 33), "K3": (30, 50)}
    assert dash.category_total.first()["total"] == 60
    comp = {r["name"]: (r["share"], r["grand_total"]) for r in dash.composition.collect()}
    assert comp == {"K1": (17, 60), "K2": (33, 60), "K3": (50, 60)}
    assert dash.igt.first()["igt_percent"] == 87.5
    assert dash.tab_counts["K1"].first().asDict() == {"shown": 1, "total": 2}
    assert [r["problem"] for r in dash.k3_pivot.collect()] == ["Sengketa", "Tidak Diisi"]
    assert dash.k3_rows.count() == 1
    assert dash.tab_counts["K3"].first().asDict() == {"shown": 1, "total": 2}
    assert dash.tab_counts["ActionPlan"].first().asDict() == {"shown": 3, "total": 3}
    assert dash.tab_counts["Capaian"].first().asDict() == {"shown": 2, "total": 2}
    assert [r["No Urut"] for r in dash.tables["K1"].collect()] == ["1"]
    assert dash.tables["IGT"].columns == ["_row", "Kab Kota", "% Capaian IGT"]
    spans = {(r["_row"], r["header"]): r["span"] for r in dash.action_plan.collect()}
    assert spans[(0, "Nama Kegiatan")] == 2 and spans[(2, "Nama Kegiatan")] == 1
    assert dash.overview_labels[0] == ("TOTAL CAPAIAN K1 NUP", "K1 NUP")


def test_status_stream_resumes_from_checkpoint(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    ckpt = os.path.join(tmp_dir, "ckpt")
    now = time.time()
    _land(landing, "K2", _payload(["Status Sertifikat"], [["proses"]]), now - 100)
    q = start_status_query(spark, landing, ckpt, query_name="status_r1")
    q.processAllAvailable()
    q.stop()
    # A restarted query (e.g. after losing the driver) keeps its state and
    # does not re-read files it already processed.
    _land(landing, "K2__retry", "broken", now)
    q = start_status_query(spark, landing, ckpt, query_name="status_r2")
    try:
        q.processAllAvailable()
        rows = {r["sheet"]: r["source"] for r in spark.sql("SELECT * FROM status_r2").collect()}
        assert rows == {"K2": "cache"}
    finally:
        q.stop()


def test_status_stream_parquet_sink(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    _land(landing, "IGT", _payload(["% Capaian IGT"], [["87,5%"]]), time.time())
    sink = os.path.join(tmp_dir, "status")
    q = start_status_query(spark, landing, os.path.join(tmp_dir, "ckpt"), sink=sink, query_name="status_sink")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {r["sheet"]: r["source"] for r in read_status(spark, sink).collect()}
    assert rows == {"IGT": "live"}


def test_dashboard_without_overview_counts_the_tabs(spark):
    texts = [("K1", _payload(["No Urut", "Status Sertifikat"], [["1", "Selesai"], ["2", "Proses"]])),
             ("K2", _payload(["No Urut", "Status Sertifikat"], [["1", "Proses"]])),
             ("K3", _payload(["No Urut", "Status Sertifikat"], [["1", "Proses"], ["2", "Proses"]]))]
    dash = J.achievement_dashboard(spark, P.parse_payloads(spark.createDataFrame(texts, "sheet string, text string")))
    assert {r["name"]: (r["total"], r["completed"]) for r in dash.summaries.collect()} == {
        "K1": (2, 1), "K2": (1, 0), "K3": (2, 0)}
    assert dash.category_total.first()["total"] == 5
    assert {r["name"]: r["share"] for r in dash.composition.collect()} == {"K1": 40, "K2": 20, "K3": 40}


def test_failed_tabs_show_their_last_good_copy(spark):
    old = _payload(["No.", "Status Sertifikat"], [["1", "Selesai"], ["2", "Proses"]])
    new = _payload(["No.", "Status Sertifikat"], [["9", "Proses"]])
    rows = [("K1", 1, old), ("K1", 2, "broken"), ("K2", 1, old), ("K2", 2, new), ("Capaian", 1, old),
            ("Capaian", 2, "broken")]
    texts = spark.createDataFrame(rows, "sheet string, t long, text string").selectExpr(
        "sheet", "CAST(t AS timestamp) AS ts", "text")
    parsed = P.parse_payloads(texts, keep=["ts"])
    dash = J.achievement_dashboard(spark, parsed)
    assert {r["sheet"]: r["source"] for r in dash.status.collect()} == {
        "K1": "cache", "K2": "live", "Capaian": "failed"}
    assert sorted(dash.sheets) == ["K1", "K2"]
    assert sorted(r["No."] for r in dash.tables["K1"].collect()) == ["1", "2"]
    # Two landed files of one tab do not add up: the later one is shown.
    assert [r["No."] for r in dash.tables["K2"].collect()] == ["9"]
    # The same from a load history that keeps the tables as JSON.
    loads = parsed.selectExpr("sheet", "ts", "ok", "to_json(table) AS data")
    last = parsed.filter("ts = CAST(2 AS timestamp)")
    again = J.achievement_dashboard(spark, last, loads=loads)
    assert sorted(r["No."] for r in again.tables["K1"].collect()) == ["1", "2"]
    assert sorted(again.sheets) == ["K1", "K2"]


def test_dashboard_with_odd_headers(spark):
    texts = [("K3", _payload(["No. Urut", "Permasalahan K3 2025", "Status", "status", "_row", "sheet", "a`b"],
                             [["1", "Sengketa", "x", "y", "r", "s", "t"], ["2", "", "x2", "y2", "r2", "s2", "t2"]])),
             ("ActionPlan", _payload(["No.", "Tgl. Terbit"], [["A", "1"], ["", "2"]]))]
    dash = J.achievement_dashboard(
        spark, P.parse_payloads(spark.createDataFrame(texts, "sheet string, text string")),
        searches={"K3": "y2"}, k3_filters={"status": ["y2"], "_row": ["r2"], "a`b": ["t2"]})
    rows = dash.k3_rows.collect()
    assert [tuple(r) for r in rows] == [(1, "2", "", "x2", "y2", "r2", "s2", "t2")]
    assert dash.tab_counts["K3"].first()["shown"] == 1
    assert ("status", "y2") in {(r["header"], r["value"]) for r in dash.k3_facets.collect()}
    spans = {(r["_row"], r["header"]): r["span"] for r in dash.action_plan.collect()}
    assert spans[(0, "No.")] == 2 and spans[(1, "Tgl. Terbit")] == 1


def test_broken_json_is_an_unknown_format(spark):
    texts = [("K1", 'cb({"status":"ok","table":);'), ("K2", 'cb({"status":"ok"});'), ("K3", "nothing")]
    got = {r["sheet"]: r["error"] for r in P.parse_payloads(
        spark.createDataFrame(texts, "sheet string, text string")).collect()}
    assert got["K1"] == got["K3"] == P.MSG_UNKNOWN_FORMAT
    assert "tidak mengembalikan tabel" in got["K2"]
