"""Register ingest from workbooks (E1) and the unit dimension (E2)."""

import os
import random

import pytest
from pyspark.sql import functions as F

from assetlens.plans import jobs as J
from assetlens.sources import workbooks as WB
from xlsx_fixture import write_xlsx


def test_decode_xlsx_cells(tmp_dir):
    p = os.path.join(tmp_dir, "a.xlsx")
    write_xlsx(p, [["no", "Kode Barang"], [1, "2010101"], [None, None], [2.5, True, None, "x"]])
    rows = list(WB.decode_xlsx(open(p, "rb").read()))
    assert rows[0] == (1, ["no", "Kode Barang"], ["s", "s"])
    assert rows[1] == (2, ["1", "2010101"], ["n", "s"])
    assert rows[3] == (4, ["2.5", "True", None, "x"], ["n", "b", "", "s"])


def test_register_frame(spark, tmp_dir):
    d = os.path.join(tmp_dir, "input_data")
    os.makedirs(d)
    header = ["No", "Jenis", "Kode Satker", "Nama  Satker", "Kode Barang", "NUP", "nilai_perolehan",
              "nilai_buku", "kab_kota"]
    write_xlsx(os.path.join(d, "aset_1.xlsx"), [
        header,
        [1, "A", "001KD", "Unit A", "2010101", 7, 1000.5, 900, "Badung"],
        [None] * 9,
        ["x", "B", "002KP", "Unit B", "3020202", "12.5", 20, 10, "Denpasar"],
    ])
    write_xlsx(os.path.join(d, "aset_2.xlsx"), [
        header,
        [12.7, "A", "001KD", "Unit A", "9999", " 12 ", 5, 5, None],
        [3, "C", "003TP", "Unit C", None, 1, None, None, "Bangli"],
    ], inline=True)
    # The unit export beside the registers is never read as a register.
    write_xlsx(os.path.join(d, "Export_UAKPB.xlsx"), [["x"], ["y"]])
    paths = [r["path"] for r in WB.discover_inputs(spark, d).collect()]
    assert [os.path.basename(p) for p in paths] == ["aset_1.xlsx", "aset_2.xlsx"]
    assert [r["path"] for r in WB.discover_inputs(spark, os.path.join(d, "none"), d).collect()] == paths
    reg = J.register_frame(spark, paths)
    assert reg.columns[:7] == ["nomor", "jenis_bmn", "kode_satker", "nama_satker", "kode_barang", "nup",
                               "golongan_bmn"]
    got = {(r["sumber_file"], r["nomor"], r["nup"], r["golongan_bmn"], r["kode_barang"],
            None if r["nilai_perolehan"] is None else float(r["nilai_perolehan"]))
           for r in reg.collect()}
    assert got == {
        ("aset_1", None, None, "PERALATAN DAN MESIN", "3020202", 20.0),
        ("aset_1", 1, 7, "TANAH", "2010101", 1000.5),
        ("aset_2", 3, 1, "TIDAK DIKENAL", None, None),
        ("aset_2", 12, 12, "TIDAK DIKENAL", "9999", 5.0),
    }
    assert dict(reg.dtypes)["nomor"] == "bigint"
    assert dict(reg.dtypes)["nilai_perolehan"] == "decimal(20,2)"
    out = os.path.join(tmp_dir, "master.parquet")
    J.build_register(spark, d, out)
    back = spark.read.parquet(out)
    assert back.count() == 4
    # partition pruning on the class folder
    plan = back.filter(F.col("golongan_bmn") == "TANAH")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "golongan_bmn" in plan


def test_unit_dimension_and_detail(spark, tmp_dir):
    p = os.path.join(tmp_dir, "Export_UAKPB.xlsx")
    blank = [None] * 25

    def unit(code, name, kl_code, kl_name, status, place):
        r = list(blank)
        r[1], r[2], r[3], r[4], r[19], r[22] = code, name, kl_code, kl_name, status, place
        return r
    write_xlsx(p, [
        ["h"] * 25,
        unit("001KD", "Unit A", 15, "Kementerian X", " AKTIF ", "Kab. Badung"),
        unit("002KP", "Unit B", 0, "Kementerian Y", "AKTIF", "Kota Denpasar, Bali"),
        unit("003TP", "Unit C", 16, "Kementerian X", "TIDAK AKTIF", "Bangli"),
        unit("004DK", "Unit D", 16, "Kementerian X", "AKTIF", "Jakarta"),
        unit("001KD", "Unit A", 15, "Kementerian X", "AKTIF", "badung"),
        blank,
    ])
    units = J.unit_dimension_frame(spark, p)
    got = sorted(tuple(r) for r in units.collect())
    assert got == [("", "Kementerian Y", "002KP", "Unit B", "KOTA DENPASAR"),
                   ("15", "Kementerian X", "001KD", "Unit A", "KAB. BADUNG")]
    reg = spark.createDataFrame([("Unit A",), ("Unit A",), ("Unit Z",)], "nama_satker string")
    detail = J.unit_detail_frame(units, reg).collect()
    assert [r["Nama Satker"] for r in detail] == ["Unit A"]
    assert list(detail[0].asDict()) == ["Kode K/L", "Nama K/L", "Kode Satker", "Nama Satker", "Kab/Kota"]


def test_error_paths(spark):
    from assetlens.operators.columns import canonical_names, union_strict
    from assetlens.sources.payloads import sheet_frame
    assert canonical_names(["No", "Kode  Barang", "extra"]) == ["nomor", "kode_barang", "extra"]
    with pytest.raises(ValueError):
        canonical_names(["jenis", "jenis_bmn"])
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(1,)], "y int")
    with pytest.raises(ValueError):
        union_strict([a, b])
    headers = spark.createDataFrame([("t", 0, "A"), ("t", 1, "A")], "sheet string, _col int, header string")
    rows = spark.createDataFrame([("t", 0, ["1", "2"])], "sheet string, _row long, cells array<string>")
    with pytest.raises(ValueError):
        sheet_frame(headers, rows)


def test_register_layouts_and_odd_headers(spark, tmp_dir):
    d = os.path.join(tmp_dir, "many")
    os.makedirs(d)
    one = ["No", "Kode Barang", "NUP", "Tgl. Terbit", "Status", "status"]
    two = ["status", "Kode Barang", "Status", "NUP", "Tgl. Terbit", "No"]
    for i in range(6):
        header, row = (one, [i, "2010101", 9007199254740993, "1-1", "S", "s"]) if i % 2 else (
            two, ["s", "3010101", "S", "9007199254740993", "1-1", i])
        write_xlsx(os.path.join(d, f"aset_{i}.xlsx"), [header, row])
    write_xlsx(os.path.join(d, "empty.xlsx"), [["other"]])
    rows = WB.pad_to_width(WB.read_workbooks(spark, WB.find_workbooks(spark, d)))
    names = [r["names"] for r in J.header_catalogue(rows).collect()]
    assert sorted(names) == sorted([one, two] * 3)
    reg = J.register_frame(spark, WB.find_workbooks(spark, d))
    got = [dict(zip(reg.columns, r)) for r in reg.collect()]
    assert len(got) == 6
    for r in got:
        assert (r["Tgl. Terbit"], r["Status"], r["status"]) == ("1-1", "S", "s")
        assert r["golongan_bmn"] == ("TANAH" if r["nomor"] % 2 else "PERALATAN DAN MESIN")
    assert {r["nup"] for r in got} == {9007199254740993}


def _rows(spark, books):
    """Decoded rows of workbooks given as {path: rows of texts}."""
    rows = [(path, i + 1, cells, ["s" if c is not None else "" for c in cells])
            for path, sheet in books.items() for i, cells in enumerate(sheet)]
    return spark.createDataFrame(rows, WB.ROWS_SCHEMA)


def test_thousands_of_layouts(spark):
    """Every workbook orders and spells its headers in a way of its own; the
    driver gets one row of the catalogue."""
    rng = random.Random(4)
    columns = {"No": 1, "Kode  Barang": 2, "NUP": 3, "Nama Satker": 4, "Tgl. Terbit": 5, "status": 6, "Status": 7}
    books = {}
    for i in range(5000):
        names = list(columns)
        rng.shuffle(names)
        values = {"No": str(i), "Kode  Barang": str(2 + i % 2) + "01", "NUP": str(7 * i), "Nama Satker": f"U{i}",
                  "Tgl. Terbit": "t", "status": "s", "Status": "S"}
        spelled = [" " * rng.randrange(3) + (n if n in ("Tgl. Terbit", "status", "Status") else rng.choice(
            [n, n.upper(), n.lower()])) for n in names]
        books[f"file:/d/aset_{i}.xlsx"] = [spelled, [values[n] for n in names], [None] * 7]
    rows = _rows(spark, books)
    catalogue = J.header_catalogue(rows)
    assert catalogue.select("names").distinct().count() > 4000
    reg = J.register_frame(spark, [], rows)
    assert reg.columns[:7] == ["nomor", "jenis_bmn", "kode_satker", "nama_satker", "kode_barang", "nup", "golongan_bmn"]
    bad = reg.filter("nup <> 7 * nomor OR nama_satker <> concat('U', nomor) OR sumber_file <> concat('aset_', nomor) "
                     "OR `Tgl. Terbit` <> 't' OR golongan_bmn <> "
                     "IF(nomor % 2 = 0, 'TANAH', 'PERALATAN DAN MESIN')")
    assert reg.count() == 5000 and bad.count() == 0
    assert sorted(map(tuple, reg.toDF(*map(str, range(len(reg.columns)))).select(
        *[str(i) for i, c in enumerate(reg.columns) if c.lower() == "status"]).distinct().collect())) in (
        [("S", "s")], [("s", "S")])


def test_catalogue_errors(spark):
    good = [["Kode Barang", "No"], ["201", "1"]]
    for books, message in (({"a": [["x"]]}, "no workbook"), ({"a": good, "b": [["Kode Barang"], ["3"]]}, "mismatch"),
                           ({"a": [["No", "x"], ["1", "2"]]}, "kode_barang"),
                           ({"a": [["No", " NO ", "Kode Barang"], ["1", "2", "3"]]}, "collision")):
        with pytest.raises(ValueError, match=message):
            J.agreed_columns(J.header_catalogue(_rows(spark, books)))
    assert J.agreed_columns(J.header_catalogue(_rows(spark, {"b": good, "a": [["No", "Kode Barang"], ["2", "3"]]}))) == [
        "nomor", "kode_barang"]


def test_cast_and_ensure_with_odd_headers(spark):
    from assetlens.operators.columns import cast_lenient, ensure_columns
    df = spark.createDataFrame([("1", "12.50", "x", "y")], "a string, b string, c string, d string").toDF(
        "nomor", "nilai_buku", "No. Urut", "no. urut")
    out = ensure_columns(cast_lenient(df, text_cols=["No. Urut"]), types={"nup": "long"})
    assert out.columns[-3:] == ["nilai_buku", "No. Urut", "no. urut"]
    assert out.first()[0] == 1 and out.first()[-1] == "y"


def test_missing_folder_lists_nothing_but_other_errors_show(spark, tmp_dir):
    assert WB.discover_inputs(spark, os.path.join(tmp_dir, "absent")).collect() == []
    assert WB.find_workbooks(spark, os.path.join(tmp_dir, "absent"), os.path.join(tmp_dir, "too")) is None
    with pytest.raises(Exception):
        WB.discover_inputs(spark, "nosuchscheme://store/in")


def test_hot_class_is_split_over_files(spark, tmp_dir):
    from assetlens.sources.parquet import read_detail, read_register, write_register
    out = os.path.join(tmp_dir, "hot.parquet")
    rows = spark.range(0, 20_000, 1, 8).selectExpr(
        "id AS nomor", "'A' AS jenis_bmn", "CAST(id AS string) AS kode_satker", "uuid() AS nama_satker",
        "CAST(id AS string) AS kode_barang", "id AS nup", "IF(id % 10 = 0, 'TANAH', 'PERSEDIAAN') AS golongan_bmn",
        "uuid() AS `Tgl. Terbit`")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "100k")
    try:
        write_register(rows, out, partition_by=["golongan_bmn"], sort_within=["nama_satker"])
    finally:
        spark.conf.set(key, before)
    hot = [f for f in os.listdir(os.path.join(out, "golongan_bmn=PERSEDIAAN")) if f.endswith(".parquet")]
    assert len(hot) > 1
    back = read_register(spark, out)
    assert back.columns == rows.columns and back.count() == 20_000
    assert spark.table("master_aset").count() == 20_000
    assert read_detail(spark, out).count() == 20_000


def test_unit_dimension_job(spark, tmp_dir):
    export = os.path.join(tmp_dir, "Export_UAKPB.xlsx")
    row = [None] * 25
    row[1], row[2], row[3], row[4], row[19], row[22] = "001KD", "Unit A", 15, "Kementerian X", "AKTIF", "Badung"
    write_xlsx(export, [["h"] * 25, row])
    register = os.path.join(tmp_dir, "register")
    spark.createDataFrame([("Unit A",)], "nama_satker string").write.parquet(register)
    units, detail = J.build_unit_dimension(spark, export, os.path.join(tmp_dir, "units"), register)
    assert [r["nama_satker"] for r in units.collect()] == ["Unit A"]
    assert [r["Nama Satker"] for r in detail.collect()] == ["Unit A"]


def test_load_history_and_payload_files(spark, tmp_dir):
    from assetlens.sources.payloads import read_sheet_payloads
    from assetlens.sources.snapshots import append_loads, latest_good_snapshot
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    with open(os.path.join(landing, "K1__2.json"), "w") as f:
        f.write('cb({"status":"ok","table":{"cols":[{"label":"Nama Unit"}],"rows":[{"c":[{"v":"x"}]}]}});')
    parsed = read_sheet_payloads(spark, landing)
    assert [(r["sheet"], r["ok"]) for r in parsed.collect()] == [("K1", True)]
    history = os.path.join(tmp_dir, "history")
    for ok in (True, False):
        append_loads(spark.createDataFrame([("K1", int(not ok), ok, "d")], "sheet string, ts long, ok boolean, data string"),
                     history)
    assert latest_good_snapshot(spark.read.parquet(history)).first()["source"] == "cache"
