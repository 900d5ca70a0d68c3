"""Sheet operators against hand-derived expectations and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from assetlens.operators import sheets as S
from assetlens.operators import windows as W
from assetlens.sources import payloads as P


def test_merge_spans_fixture(spark):
    vals = ["", "A", " ", "B", "", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "_row long, c string")
    got = W.merge_spans(df, ["c"]).orderBy("_row").collect()
    assert [r["span"] for r in got] == [None, 2, None, 3, None, None]
    assert [r["covered"] for r in got] == [False, False, True, False, True, True]
    assert [r["filled"] for r in got] == ["", "A", "A", "B", "B", "B"]


def _brute_spans(values):
    spans, covered, filled = [None] * len(values), [False] * len(values), [""] * len(values)
    head = None
    for i, v in enumerate(values):
        if v.strip():
            head = i
            spans[i] = 1
            filled[i] = v
        elif head is not None:
            spans[head] += 1
            covered[i] = True
            filled[i] = values[head]
    return spans, covered, filled


def test_running_count_buckets_match_brute_force(spark):
    rng = random.Random(7)
    rows = []
    expected = {}
    for col in ("x", "y"):
        pos = sorted(rng.sample(range(0, 400), 120))
        vals = [rng.choice(["", "", " ", "a", "b"]) for _ in pos]
        expected[col] = (pos, _brute_spans(vals))
        rows += [(col, p, v) for p, v in zip(pos, vals)]
    df = spark.createDataFrame(rows, "header string, _row long, value string")
    wide = df.groupBy("_row").pivot("header", ["x", "y"]).agg(F.first("value"))
    # Rows missing from one column are simply absent there: use long input per column.
    for col in ("x", "y"):
        one = df.filter(F.col("header") == col).select("_row", F.col("value").alias(col))
        for bucket in (7, 64, 1 << 20):
            got = W.merge_spans(one, [col], bucket_rows=bucket).orderBy("_row").collect()
            pos, (spans, covered, filled) = expected[col]
            assert [r["_row"] for r in got] == pos
            assert [r["span"] for r in got] == spans
            assert [r["covered"] for r in got] == covered
            assert [r["filled"] for r in got] == filled
    assert wide.count() > 0


def test_spans_cover_rows_minus_leading_blanks(spark):
    vals = ["", "", "x", "", "y", "", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "_row long, c string")
    total = W.merge_spans(df, ["c"]).agg(F.sum("span")).first()[0]
    assert total == len(vals) - 2


def _unique(spark, tabs, **kw):
    """Unique headers of each tab, {tab: names in column order}."""
    rows = [(t, i, n) for t, names in tabs.items() for i, n in enumerate(names)]
    out = {t: [None] * len(names) for t, names in tabs.items()}
    for r in S.unique_headers(spark.createDataFrame(rows, "sheet string, _col int, header string"), **kw).collect():
        out[r["sheet"]][r["_col"]] = r["unique_header"]
    return out


def test_unique_headers_two_passes(spark):
    got = _unique(spark, {"a": ["A b", "A  b", "", " A b "], "b": ["A", "A", "A 2"]}, bucket_rows=2)
    assert got == {"a": ["A b", "A b 2", "Kolom 3", "A b 3"], "b": ["A", "A 2", "A 2 2"]}


@pytest.mark.parametrize("bucket_rows", [1, 3, 1 << 16])
def test_unique_headers_brute_force(spark, bucket_rows):
    """Stems above and below the size that is dealt by buckets."""
    rng = random.Random(bucket_rows)
    tabs = {f"t{k}": [rng.choice(["A", "A 2", "A 2 2", "A 3", "B", "B 2", "", "Kolom 2", "C"])
                      for _ in range(rng.randrange(1, 30))] for k in range(12)}
    want = {}
    for tab, names in tabs.items():
        names = [n or f"Kolom {i + 1}" for i, n in enumerate(names)]
        for _ in range(2):
            seen, out = {}, []
            for n in names:
                seen[n] = seen.get(n, 0) + 1
                out.append(n if seen[n] == 1 else f"{n} {seen[n]}")
            names = out
        want[tab] = names
    assert _unique(spark, tabs, bucket_rows=bucket_rows) == want


def test_facets_without_headers(spark):
    assert S.facet_options(spark.createDataFrame([(1,)], "_row long")).collect() == []


def _payload(labels, rows):
    import json
    return "cb(" + json.dumps({"status": "ok", "table": {
        "cols": [{"id": chr(65 + i), "label": l} for i, l in enumerate(labels)],
        "rows": [{"c": [None if v is None else {"v": v} for v in r]} for r in rows]}}) + ");"


def _normalize(spark, sheet, text):
    parsed = P.parse_payloads(spark.createDataFrame([(sheet, text)], "sheet string, text string"))
    headers, rows = P.normalize_payloads(parsed)
    hs = [r["header"] for r in headers.orderBy("_col").collect()]
    return hs, [(r["_row"], list(r["cells"])) for r in rows.orderBy("_row").collect()]


def test_header_row_promotion(spark):
    hs, rows = _normalize(spark, "t", _payload(["A", "B", "C"], [["No", "Nama", ""], ["1", "x", "y"]]))
    assert hs == ["No", "Nama", "Kolom 3"]
    assert rows == [(0, ["1", "x", "y"])]
    # every one-word header counts as generic (compat rule): first row is taken
    hs, rows = _normalize(spark, "t", _payload(["A", "Nama"], [["a", "b"], ["c", "d"]]))
    assert hs == ["a", "b"] and rows == [(0, ["c", "d"])]
    hs, rows = _normalize(spark, "t", _payload(["Nama Satker", "A"], [["a", "b"]]))
    assert hs == ["Nama Satker", "A"] and rows == [(0, ["a", "b"])]


def test_widening_blank_rows_and_numbers(spark):
    text = _payload(["Nama Satker", "Nilai"], [["a", 1.0, "extra"], [None, "  ", None], ["b", 2.5]])
    hs, rows = _normalize(spark, "t", text)
    assert hs == ["Nama Satker", "Nilai", "Kolom 3"]
    assert rows == [(0, ["a", "1", "extra"]), (2, ["b", "2.5", ""])]


def test_bad_payloads(spark):
    texts = [("a", "garbage"), ("b", 'x({"status":"error","errors":[{"detailed_message":"no access"}]})'),
             ("c", '({"status":"ok"})'), ("d", _payload(["X y"], [["1"]]))]
    out = {r["sheet"]: r for r in P.parse_payloads(spark.createDataFrame(texts, "sheet string, text string")).collect()}
    assert not out["a"]["ok"] and "tidak dikenali" in out["a"]["error"]
    assert out["b"]["error"] == "no access"
    assert "tidak mengembalikan tabel" in out["c"]["error"]
    assert out["d"]["ok"]


def test_letter_headers(spark):
    text = _payload(["x", "y"], [["h1", "h2"], ["", " "], ["1", "2"]])
    parsed = P.parse_payloads(spark.createDataFrame([("t", text)], "sheet string, text string"))
    got = P.sheet_with_letter_headers(parsed).orderBy("_row", "column").collect()
    assert [(r["_row"], r["column"], r["value"]) for r in got] == [
        (0, "A", "h1"), (0, "B", "h2"), (2, "A", "1"), (2, "B", "2")]
    idx = spark.range(1).select(*[P.column_letters(F.lit(i)).alias(f"c{i}") for i in (0, 25, 26, 701, 702)])
    assert list(idx.first()) == ["A", "Z", "AA", "ZZ", "AAA"] == [P.letters_of(i) for i in (0, 25, 26, 701, 702)]


def test_scatter_is_the_inverse_of_long_cells(spark):
    text = _payload(["x"], [["h1", "h2", "h3"], ["", " "], ["1", None, "3"], [], ["z"]])
    parsed = P.parse_payloads(spark.createDataFrame([("t", text)], "sheet string, text string"))
    long = P.sheet_with_letter_headers(parsed).select("sheet", "_row", (F.ascii("column") - 65).alias("_col"), "value")
    rows = P.scatter_cells(long)
    sheet = P.letter_sheet(rows, with_sheet=False).orderBy("_row")
    assert sheet.columns == ["_row", "A", "B", "C"]
    assert [tuple(r) for r in sheet.collect()] == [(0, "h1", "h2", "h3"), (2, "1", "", "3"), (4, "z", "", "")]


def test_scatter_reads_cells_once_and_deals_them_once(spark):
    cells = spark.createDataFrame(
        [("t", 1, 0, "a"), ("t", 1, 0, "b"), ("t", 1, 2, None), ("u", 1, 4, "e"), ("t", 2, 1, "c"), ("u", 2, 0, "f"),
         (None, 1, 7, "x")], "sheet string, _row long, _col int, value string")
    widths = P.cell_widths(cells)
    want = {("t", 1): ["b", "", ""], ("t", 2): ["", "c", ""], ("u", 1): ["", "", "", "", "e"],
            ("u", 2): ["f", "", "", "", ""]}
    for rows in (P.scatter_cells(cells), P.scatter_cells(cells, widths)):
        assert {(r["sheet"], r["_row"]): r["cells"] for r in rows.collect()} == want
    rows = P.scatter_cells(cells, widths)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    # the sheet's width is known without the rows, which fail if they are read
    unread = rows.withColumn("cells", F.transform("cells", lambda c: F.raise_error(F.lit("read")).cast("string")))
    assert P.letter_sheet(unread, widths=widths).columns == ["sheet", "_row", "A", "B", "C", "D", "E"]
    assert P.letter_sheet(rows, widths=widths).exceptAll(P.letter_sheet(rows)).count() == 0
    none = cells.limit(0)
    assert P.letter_sheet(P.scatter_cells(none), widths=P.cell_widths(none)).columns == ["sheet", "_row"]


def test_facets_fixture(spark):
    df = spark.createDataFrame([("x", "1"), ("y", "1"), ("x", "2"), ("y", "2")], "a string, b string")
    got = S.facet_options(df, {"a": ["x"], "b": ["1"]}).collect()
    opts = {(r["header"], r["value"]) for r in got}
    assert opts == {("a", "x"), ("a", "y"), ("b", "1"), ("b", "2")}
    assert S.filter_sheet(df, {"a": ["x"], "b": ["1"]}).count() == 1
    assert S.filter_sheet(df, {"a": []}).count() == 0
    # no filters: facets = plain distinct values
    plain = {(r["header"], r["value"]) for r in S.facet_options(df).collect()}
    assert plain == {("a", "x"), ("a", "y"), ("b", "1"), ("b", "2")}


def test_is_completed(spark):
    def done(row):
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
        return df.select(S.completion_flag(list(row))).first()[0]
    assert done({"Status": "Sudah terbit"})
    assert not done({"Status": "Proses", "Ket": "selesai"})
    assert done({"Ket": "selesai"})
    assert done({"Status": "Belum bersertifikat"})


def test_problem_pivot(spark):
    df = spark.createDataFrame([("Sengketa",), (" Sengketa ",), ("",), ("Batas",)], "`Permasalahan K3 2025` string")
    got = [(r["problem"], r["jumlah"]) for r in S.problem_pivot(df).collect()]
    assert got == [("Sengketa", 2), ("Batas", 1), ("Tidak Diisi", 1)]


def test_completion_and_composition(spark):
    df = spark.createDataFrame([("selesai",), ("proses",), ("100%",)], "Status string")
    s = S.completion_summary(df, "K1").first()
    assert (s["total"], s["completed"], s["percent"]) == (3, 2, 67)
    sums = spark.createDataFrame([("K1", 1), ("K2", 0), ("K3", 99)], "name string, total long")
    comp = {r["name"]: (r["share"], r["width"]) for r in S.composition(sums).collect()}
    assert comp == {"K1": (1, 3), "K2": (0, 3), "K3": (99, 99)}
    zero = spark.createDataFrame([("K1", 0)], "name string, total long")
    assert S.composition(zero).count() == 0


def test_igt_kpi_caps(spark):
    df = spark.createDataFrame([(1, "Capaian", "120%"), (0, "x", "87,5%")], "_row long, a string, `% Capaian` string")
    r = S.igt_kpi(df).first()
    assert (r["igt_display"], r["igt_percent"], r["row_count"]) == ("87,5%", 87.5, 2)
    df2 = spark.createDataFrame([(0, "120%")], "_row long, `% capaian` string")
    assert S.igt_kpi(df2).first()["igt_percent"] == 100.0


def test_index_rows_and_data_row(spark):
    hs = [f"h{i}" for i in range(8)]
    rows = [(0, "1", "2", "3", "4", "5", "6", "", ""), (1, "=a", "+b", "c", "d", "e", "f", "", ""),
            (2, "12345", "Kantor", "", "", "", "", "", ""), (3, "x", "", "", "", "", "", "", "")]
    df = spark.createDataFrame(rows, "_row long, " + ", ".join(f"{h} string" for h in hs))
    kept = [r["_row"] for r in S.drop_index_rows(df, hs).orderBy("_row").collect()]
    assert kept == [2, 3]
    assert S.find_data_row(df, hs).first()["_row"] == 2


def test_kpi_other_layouts(spark):
    letters = [P.column_letters(F.lit(i)) for i in range(50)]
    names = list(spark.range(1).select(*[c.alias(f"x{i}") for i, c in enumerate(letters)]).first())
    header_row = ["Kode", "Kantor"] + [""] * 48
    data = ["12345", "Unit Pusat"] + ["0"] * 48
    data[25], data[26], data[38], data[39], data[47] = "1.500", "12", "3.000", "50%", "7"
    rows = [(0, *header_row), (1, *data)]
    df = spark.createDataFrame(rows, "_row long, " + ", ".join(f"{n} string" for n in names))
    k = S.achievement_kpis_positional(df).first()
    assert (k["k1_nup"], k["k1_bidang"], k["total_bidang"], k["total_q1"], k["konsolidasi_bidang"]) == (
        1500.0, 12.0, 3000.0, "50%", 7.0)
    hs = ["TOTAL CAPAIAN K1 NUP", "Bidang", "K2 NUP", "Bidang 2", "K2 NUP baru", "Bidang 3",
          "JUMLAH KOMPONEN A Capaian", "Q1", "Pct", "Permasalahan Hukum", "Q1 2", "Pct 2"]
    rows = [(0, "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12"),
            (1, "10", "1", "20", "2", "30", "3", "60", "q", "p", "5", "hq", "hp")]
    df = spark.createDataFrame(rows, "_row long, " + ", ".join(f"`{h}` string" for h in hs))
    k = S.achievement_kpis_last_match(df).first()
    assert (k["k1_nup"], k["k2_nup"], k["k2_bidang"], k["total_bidang"], k["total_q1"], k["hukum_pct"]) == (
        10.0, 30.0, 3.0, 60.0, "q", "hp")


def test_merge_spans_per_sheet(spark):
    rows = [("s1", 0, "A"), ("s1", 1, ""), ("s2", 0, ""), ("s2", 1, "B"), ("s2", 2, ""), ("s1", 2, "")]
    df = spark.createDataFrame(rows, "sheet string, _row long, c string")
    got = {(r["sheet"], r["_row"]): (r["span"], r["covered"], r["filled"])
           for r in W.merge_spans(df, ["c"], sheet_keys=["sheet"], bucket_rows=2).collect()}
    assert got == {("s1", 0): (3, False, "A"), ("s1", 1): (None, True, "A"), ("s1", 2): (None, True, "A"),
                   ("s2", 0): (None, False, ""), ("s2", 1): (2, False, "B"), ("s2", 2): (None, True, "B")}


def test_column_letters_have_no_limit(spark):
    cases = {0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA", 475253: "ZZZZ",
             475254: "AAAAA"}
    df = spark.createDataFrame([(i,) for i in cases], "i long")
    got = {r["i"]: r["c"] for r in df.select("i", P.column_letters(F.col("i")).alias("c")).collect()}
    assert got == cases


def test_odd_headers_in_every_sheet_operator(spark):
    names = ["No.", "Status", "status", "Nilai `a`", "Tgl. Terbit"]
    sheet = spark.createDataFrame([("1", "a", "B", "x", "1-1"), ("2", "a", "C", "", ""), ("3", "b", "C", "y", "")],
                                  "c0 string, c1 string, c2 string, c3 string, c4 string").toDF(*names)
    assert S.search_sheet(sheet, "1-1").count() == 1
    assert S.filter_sheet(sheet, {"status": ["C"], "Status": ["a"]}).count() == 1
    assert S.informative_headers(sheet) == names
    facets = [(r["header"], r["label"]) for r in S.facet_options(sheet, {"status": ["C"]}).collect()]
    assert ("Status", "b") in facets and ("status", "B") in facets
    numbered = spark.createDataFrame([(0, "1", "a"), (1, "", "")], "_row long, c0 string, c1 string").toDF(
        "_row", "No.", "no.")
    spans = {(r["_row"], r["header"]): r["span"] for r in W.merge_spans(numbered).collect()}
    assert spans[(0, "No.")] == 2 and spans[(0, "no.")] == 2


def test_facets_come_in_natural_order(spark):
    sheet = spark.createDataFrame([("item 10",), ("Item 2",), ("",), ("item 1",)], "`a.b` string")
    assert [r["label"] for r in S.facet_options(sheet).collect()] == ["item 1", "Item 2", "item 10", "Tidak Diisi"]


def test_newest_payload_moves_one_body(spark):
    """A tab with 1,000 landed versions: the latest good one is found on time
    and hash alone, and no window holds payload bodies."""
    texts = [("t", i, _payload(["Nama Unit", "b"], [[str(i), "x" * 50]])) for i in range(1000)]
    texts += [("t", 2000, "broken"), ("t", 999, texts[-1][2]), ("u", 5, _payload(["Nama Unit"], [])), ("v", 1, "broken")]
    df = spark.createDataFrame(texts, "sheet string, ts long, text string").repartition(8)
    newest = P.newest_payloads(P.parse_payloads(df, keep=["ts"]))
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "LeftSemi" in plan
    rows = {r["sheet"]: r["table"]["rows"] for r in newest.select("sheet", F.struct(
        F.transform("table.rows", lambda r: r["c"][0]["v"].cast("string")).alias("rows")).alias("table")).collect()}
    assert rows == {"t": ["999"], "u": []}


def test_chunks_keep_the_rows_in_order(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_ROWS", 7)
    text = _payload(["A", "B"], [["Nama Unit", "Nilai"]] + [[f"r{i}", i] if i % 10 else [None, ""] for i in range(50)]
                    + [["wide", 1, "c"]])
    hs, rows = _normalize(spark, "t", text)
    assert hs == ["Nama Unit", "Nilai", "Kolom 3"]
    assert rows == [(i, [f"r{i}", str(i), ""]) for i in range(50) if i % 10] + [(50, ["wide", "1", "c"])]


def test_wide_sheets_are_searched(spark):
    """A condition over 60 columns plans at once."""
    from assetlens.operators.filters import drop_blank_rows
    names = [f"Kolom {i}" for i in range(60)]
    sheet = spark.range(20).select(F.col("id").alias("_row"), *[
        F.when(F.col("id") % 2 == 0, F.concat(F.lit(f"c{i}-"), F.col("id").cast("string"))).otherwise(F.lit("")).alias(n)
        for i, n in enumerate(names)])
    assert [r["_row"] for r in S.search_sheet(sheet, "c59-4").collect()] == [4]
    assert S.filter_sheet(sheet, {"Kolom 3": ["c3-2"]}, search="c0-").count() == 1
    assert drop_blank_rows(sheet, names, blank_is_empty=True).count() == 10
    assert S.drop_index_rows(sheet).count() == 0  # every text holds a sign
