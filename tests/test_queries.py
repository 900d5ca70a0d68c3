"""Registered queries against their DuckDB oracles (sf0.001), the driver
contract, the dashboards, and the shape of the physical plans."""

import re
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from assetlens.operators import aggregate as A
from assetlens.plans import bindings as B
from assetlens.plans import jobs as J
from assetlens.plans import queries as Q
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def c(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    out = [tuple(c(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["golongan_bmn", "is_total", "jumlah_aset", "total_nilai_perolehan", "total_nilai_buku"]


def test_every_query_has_an_oracle():
    missing = set(Q.QUERIES) - set(E.oracle_sql())
    assert not missing, missing


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    assert _canon(s_rows, df.columns) == _canon(o_rows, o_cols)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_plans_take_ordered(spark):
    plan = _plan(E.queries()["top_units_value"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_agency_semi_join_and_no_python(spark):
    df = A.dashboard_filter(B.assets(spark, SF_SMALL), B.units(spark, SF_SMALL), agencies=Q.SEL_AGENCIES)
    assert "LeftSemi" in _plan(df)
    assert df.count() == E.queries()["filter_agency_semi"](spark, SF_SMALL).count()
    for name in ("summary_filtered", "dashboard_grouping_sets", "facet_options", "merge_spans", "place_layer"):
        p = _plan(E.queries()[name](spark, SF_SMALL))
        assert "Python" not in p and "ArrowEvalPython" not in p, name


def test_scan_prunes_columns(spark):
    df = E.queries()["summary_by_class"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    read_schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "l_partkey" in read_schema and "l_shipdate" not in read_schema and "l_tax" not in read_schema


def test_grouping_sets_single_scan(spark):
    # Class, type, place and total groups come from ONE scan of the register.
    df = E.queries()["dashboard_grouping_sets"](spark, SF_SMALL)
    plan = _plan(df)
    assert plan.count("lineitem.parquet") == 1
    assert "Expand" in plan


def test_total_row_equals_sum_of_classes(spark):
    rows = E.queries()["summary_with_total"](spark, SF_SMALL).collect()
    total = [r for r in rows if r["is_total"]][0]
    parts = [r for r in rows if not r["is_total"]]
    assert total["jumlah_aset"] == sum(r["jumlah_aset"] for r in parts)
    assert abs(total["total_nilai_perolehan"] - sum(r["total_nilai_perolehan"] for r in parts)) < 1e-6


def test_total_row_kept_apart_from_null_class(spark):
    from assetlens.operators.aggregate import metric_cards, summary_with_total
    df = spark.createDataFrame([("TANAH", 1.0, 1.0), ("TANAH", 2.0, 1.0), (None, 3.0, 1.0)],
                               "golongan_bmn string, nilai_perolehan double, nilai_buku double")
    rows = summary_with_total(df).collect()
    assert [(r["golongan_bmn"], r["is_total"], r["jumlah_aset"]) for r in rows] == [
        ("TANAH", False, 2), (None, False, 1), ("TOTAL", True, 3)]
    empty = df.filter("golongan_bmn = 'X'")
    assert summary_with_total(empty).filter("NOT is_total").count() == 0
    m = metric_cards(empty).first()
    assert (m["jumlah_aset"], m["total_nilai_perolehan"]) == (0, 0.0)


def test_agency_fan_out_counts_twice(spark):
    from assetlens.operators.aggregate import top_k_agencies
    units = spark.createDataFrame([("KL1", "U1"), ("KL1", "U1")], "`Nama K/L` string, `Nama Satker` string")
    reg = spark.createDataFrame([(1, "U1", 1.0), (2, "U1", 1.0), (None, "U1", 1.0)],
                                "nomor long, nama_satker string, nilai_perolehan double")
    assert top_k_agencies(units, reg, "value").first()["total_nilai"] == 6.0
    assert top_k_agencies(units, reg, "count").first()["total_nilai"] == 4
    assert top_k_agencies(units, reg, "value", dedupe=True).first()["total_nilai"] == 3.0


def test_register_dashboard_job(spark):
    reg = B.assets(spark, SF_SMALL)
    units = B.units(spark, SF_SMALL)
    agency = units.orderBy("Nama K/L").first()["Nama K/L"]
    dash = J.register_dashboard(spark, reg, units, J.Selection(types=["A"], agencies=[agency]),
                                centres=B.REGION_CENTRES)
    assert dash.missing_columns == []
    m = dash.metrics.first()
    assert m["jumlah_aset"] > 0
    fused = {r["dimension"]: r for r in dash.fused.collect() if r["dimension"] == "total"}
    assert fused["total"]["jumlah_aset"] == m["jumlah_aset"]
    assert dash.summary.filter("is_total").first()["jumlah_aset"] == m["jumlah_aset"]
    n_units = reg.select("nama_satker").distinct().count()
    assert dash.top_units["value"].count() == min(20, n_units)
    drill = J.unit_drilldown(spark, units, "ASIA", centres=B.REGION_CENTRES)
    assert drill.listing.count() == drill.overview.first()["jumlah_satker"]


JOINED = ["top_units_value", "top_units_count", "top_agencies_value", "top_agencies_count", "place_layer",
          "distinct_units", "restrict_to_used", "summary_filtered", "metric_cards_filtered", "dashboard_grouping_sets"]


@pytest.fixture()
def no_broadcast(spark):
    """A threshold that stands in for a large supplier table."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1024")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", JOINED)
def test_lineitem_is_reduced_before_the_unit_join(spark, no_broadcast, name):
    # Every exchange of lineitem rows sits above their partial aggregate.
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "lineitem.parquet" in x)
    above = [x for x in lines[:scan] if "Join" in x or "Aggregate" in x]
    assert "partial_" in above[-1] or "functions=[]" in above[-1], above[-1]
    assert plan.count("lineitem.parquet") == 1


def test_filtered_queries_join_the_dimension_once(spark):
    for name in ("summary_filtered", "metric_cards_filtered", "dashboard_grouping_sets", "filter_agency_semi"):
        assert _plan(E.queries()[name](spark, SF_SMALL)).count("supplier.parquet") == 1, name


def _final(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_merge_spans_shuffles_sheet_rows_once(spark):
    from assetlens.operators.windows import merge_spans
    df = spark.createDataFrame([(i, "x" if i % 3 == 0 else "", "") for i in range(20)], "_row long, a string, b string")
    final = _final(merge_spans(df, bucket_rows=4))
    assert final.count("Exchange hashpartitioning(__b") == 1 or "ReusedExchange" in final, final
    assert len(re.findall(r"[-+] Window", final)) <= 5, final
    assert len(re.findall(r"Sort \[__b[^]]*__row", final)) <= 2, final


def test_facets_sort_by_a_key_column(spark):
    """Neither a regular expression nor a collation inside a sort."""
    for name in ("facet_options", "facet_order", "odd_header_facets", "natural_order"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        sorts = [line for line in plan.splitlines() if re.match(r"[\s:+-]*Sort ", line)]
        assert sorts and not any("regexp" in line or "collate" in line for line in sorts), plan


def test_money_sums_hold_more_than_sixteen_digits(spark):
    from decimal import Decimal
    big = Decimal("999999999999999999.99")
    rows = spark.createDataFrame([("TANAH", big, big)] * 100, f"golongan_bmn string, nilai_perolehan {B.LINE_MONEY}, "
                                 f"nilai_buku {B.LINE_MONEY}")
    assert A.metric_cards(rows).first()["total_nilai_perolehan"] == float(big * 100)
    cube = A.register_cube(rows.selectExpr("*", "1 AS nomor"), ["golongan_bmn"])
    assert A.metric_cards(cube).first().asDict() == A.metric_cards(rows).first().asDict()


def test_unit_codes_of_long_keys_stay_apart(spark):
    keys = [7, 1234567890, 1234567891, 12345678901]
    codes = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(
        B.unit_code(F.col("k"))).collect()]
    assert [c[:-2] for c in codes] == ["000000007", "1234567890", "1234567891", "12345678901"]


def test_register_dashboard_reads_the_register_once(spark):
    dash = J.register_dashboard(spark, B.assets(spark, SF_SMALL), B.units(spark, SF_SMALL),
                                J.Selection(types=["A"]), centres=B.REGION_CENTRES)
    for df in (dash.metrics, dash.summary, dash.by_type, dash.place_layer, dash.fused, dash.top_units["value"],
               dash.top_agencies["count"], dash.options["nama_satker"]):
        assert "lineitem.parquet" not in _plan(df)
