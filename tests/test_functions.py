"""Golden values of the scalar expressions (FIXTURES.md part C)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlens.functions import (classify_by_prefix, clean_header, clean_place_contains, clean_place_exact,
                                 format_id_number, format_rupiah, metric_with_pct, natural_sort_key,
                                 parse_id_number, parse_percent_prefix, text_or_blank)
from assetlens.functions.classify import PUNCTUATION_ORDER
from assetlens.operators.columns import lenient_long


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_format_rupiah(spark):
    vals = [None, 0.0, 1.0, 999999.5, 1000000.0, 1234567890.0, -2500000000.0, 1.5e12, 1.234e15, -0.4]
    assert one_col(spark, vals, format_rupiah, "double") == [
        "-", "-", "Rp 1", "Rp 1,000,000", "Rp 1.00 Jt", "Rp 1.23 M", "Rp -2.50 M", "Rp 1.50 T",
        "Rp 1,234.00 T", "Rp -0"]


def test_parse_id_number(spark):
    vals = ["1.234,56", "12,5%", "1,2,3", "-", "1-2", "", "abc", "95.5 abc", "120%", "-3", "Rp 1.000", None]
    assert one_col(spark, vals, parse_id_number) == [
        1234.56, 12.5, 1.23, 0.0, 0.0, 0.0, 0.0, 955.0, 120.0, -3.0, 1000.0, 0.0]


def test_parse_percent_prefix(spark):
    vals = ["1.234,56", "12,5%", "1,2,3", "-", "1-2", "", "abc", "95.5 abc", "120%", "-3", "Rp 1.000", " 7e1x"]
    assert one_col(spark, vals, parse_percent_prefix) == [
        1.234, 12.5, 1.2, 0.0, 1.0, 0.0, 0.0, 95.5, 120.0, -3.0, 0.0, 70.0]


def test_places(spark):
    vals = [" Badung ", "Kab. Bangli", "Kabupaten Bangli", "Kuta Selatan", "Denpasar, Bali", "Bali",
            "Badung dan Tabanan", "Jakarta", None]
    assert one_col(spark, vals, clean_place_contains) == [
        "KAB. BADUNG", "KAB. BANGLI", "KAB. BANGLI", "KAB. BADUNG", "KOTA DENPASAR", None, "KAB. BADUNG", None, None]
    assert one_col(spark, vals, clean_place_exact) == [
        "KAB. BADUNG", "KAB. BANGLI", "KABUPATEN BANGLI", "KUTA SELATAN", "DENPASAR, BALI", "KOTA DENPASAR",
        "BADUNG DAN TABANAN", "JAKARTA", None]


def test_classify(spark):
    vals = ["2010101", "1999", "9123", "", None, "8"]
    assert one_col(spark, vals, classify_by_prefix) == [
        "TANAH", "PERSEDIAAN", "TIDAK DIKENAL", "TIDAK DIKENAL", "TIDAK DIKENAL", "ASET TAK BERWUJUD"]


def test_lenient_long(spark):
    vals = ["12", "12.5", "x", " 12 ", None]
    assert one_col(spark, vals, lambda c: lenient_long(c, F.lit("s"))) == [12, None, None, 12, None]
    assert one_col(spark, ["12.7"], lambda c: lenient_long(c, F.lit("n"))) == [12]


def test_clean_header_nbsp(spark):
    vals = ["A b", "A  b", "", " A b ", "a  b", None, "\tx\n"]
    assert one_col(spark, vals, clean_header) == ["A b", "A b", "", "A b", "a b", "", "x"]
    # idempotent
    once = one_col(spark, vals, clean_header)
    assert one_col(spark, once, clean_header) == once


def test_format_id_number(spark):
    vals = [1234.0, 1234.5, 0.1234, -1234567.891, 0.0, None, 1000000.0]
    assert one_col(spark, vals, format_id_number, "double") == [
        "1.234", "1.234,5", "0,123", "-1.234.567,891", "0", "0", "1.000.000"]


def test_metric_with_pct(spark):
    df = spark.createDataFrame([(1234.0, "10%", ""), (5.0, "", "")], "v double, q string, p string")
    got = [r[0] for r in df.select(metric_with_pct("v", "q", "p")).collect()]
    assert got == ["1.234 bidang (10%)", "5 bidang"]


def test_text_or_blank(spark):
    # Only a number is falsy as zero; the texts stay.
    assert one_col(spark, ["0", "000", "x", "", None], text_or_blank) == ["0", "000", "x", "", ""]
    assert one_col(spark, [0, 7, None], text_or_blank, "long") == ["", "7", ""]


def test_natural_sort_key(spark):
    vals = ["item 10", "item 2", "Item 1", "b"]
    keys = one_col(spark, vals, natural_sort_key)
    order = [v for _, v in sorted(zip(keys, vals))]
    assert order == ["b", "Item 1", "item 2", "item 10"]
    # Runs of any length keep their value.
    long = ["x " + "1" * 31, "x " + "1" * 32, "x 2" + "0" * 31, "x 1" + "0" * 31 + "2"]
    keys = one_col(spark, long, natural_sort_key)
    assert len(set(keys)) == 4
    assert [v for _, v in sorted(zip(keys, long))] == sorted(long, key=lambda v: int(v[2:]))


def test_natural_sort_key_agrees_with_the_collation(spark):
    """Without digits the bytes order labels as the accent- and case-blind
    collation does; labels it calls equal come by the label itself."""
    rng = random.Random(2)
    letters = "aAbBzZeEéÈñÑöÖßæœÿ çÇ" + PUNCTUATION_ORDER[5:]
    labels = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(7))) for _ in range(3000)})
    df = spark.createDataFrame([(x,) for x in labels], "label string").withColumn("key", natural_sort_key("label"))
    order = Window.orderBy("key")
    follows = df.withColumn("before", F.lag("label").over(order)).filter(
        F.collate("before", "id_CI_AI") > F.collate("label", "id_CI_AI"))
    assert [(r["before"], r["label"]) for r in follows.collect()] == []
    assert df.select("key").distinct().count() == len(labels)


@pytest.mark.parametrize("q,ok", [("foo", True), ("O B", True), (" bar ", True), ("foobar", False)])
def test_search_spans_cells(spark, q, ok):
    from assetlens.operators.filters import search_rows
    df = spark.createDataFrame([("Foo", "Bar")], "a string, b string")
    assert (search_rows(df, q).count() == 1) is ok


def test_small_operators(spark):
    from assetlens.functions import display_or_dash, format_count
    from assetlens.operators.aggregate import append_total, metric_cards, summary_by_class
    from assetlens.operators.filters import drop_blank_rows, filter_active
    assert one_col(spark, [1234567.0, 0.0], format_count, "double") == ["1,234,567", "0"]
    assert one_col(spark, ["  a  b ", "", None], display_or_dash) == ["a b", "-", "-"]
    df = spark.createDataFrame([(" AKTIF ",), ("TIDAK AKTIF",), (None,)], "s string")
    assert filter_active(df, "s").count() == 1
    rows = spark.createDataFrame([(None, None), (" ", None), ("x", None)], "a string, b string")
    assert drop_blank_rows(rows).count() == 2
    assert drop_blank_rows(rows, blank_is_empty=True).count() == 1
    reg = spark.createDataFrame([("TANAH", 1.0, 1.0), ("PERSEDIAAN", 2.0, 2.0)],
                                "golongan_bmn string, nilai_perolehan double, nilai_buku double")
    out = append_total(summary_by_class(reg), metric_cards(reg), "golongan_bmn").collect()
    assert [r["golongan_bmn"] for r in out][-1] == "TOTAL" and out[-1]["jumlah_aset"] == 2
