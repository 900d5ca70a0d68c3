"""Order-dependent operators over sheet rows: merged-cell spans and fill-down.

Both rest on one primitive, a running count over ordered rows.  A plain
window partitioned by the sheet column would put a whole column - possibly a
third of all rows - into one task, so the count is computed per bucket of
the ordering key (``order // bucket_rows``) and completed with the total of
the earlier buckets, taken from a per-bucket summary that is
``bucket_rows`` times smaller than the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim
from .slots import Slots

DEFAULT_BUCKET_ROWS = 1 << 16


def running_count(df: DataFrame, keys: Sequence[str], order_col: str, flag: Column | None = None,
                  out: str = "running", bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Inclusive running count of the rows (or of the rows where ``flag``)
    per ``keys`` in ``order_col`` order.  ``order_col`` must be an integer
    that is unique within ``keys``."""
    keys = list(keys)
    d = (df.withColumn("__b", F.floor(F.col(order_col) / F.lit(bucket_rows)))
         .withColumn("__f", F.when(flag, F.lit(1)).otherwise(F.lit(0)) if flag is not None else F.lit(1)))
    local_w = (Window.partitionBy(*keys, "__b").orderBy(order_col)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__local", F.sum("__f").over(local_w))
    # The running count's largest value is the bucket's total: taken from the
    # same partitions, it needs no exchange of its own.
    per_bucket = d.groupBy(*keys, "__b").agg(F.max("__local").alias("__bc"))
    # One row per bucket: tiny next to the data even for the hottest key.
    carry_w = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "__b", F.coalesce(F.sum("__bc").over(carry_w), F.lit(0)).alias("__carry"))
    d = d.join(carry, [*keys, "__b"], "left")
    return d.withColumn(out, (F.col("__local") + F.col("__carry")).cast("long")).drop(
        "__b", "__f", "__local", "__carry")


def merge_spans(sheet: DataFrame, headers: Sequence[str] | None = None, row_col: str = "_row",
                sheet_keys: Sequence[str] = (), bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Merged-cell reconstruction over the (already filtered) rows, per
    column: a non-blank cell spans itself and the blank cells below it up to
    the next non-blank one; blank cells above the first non-blank one stay
    uncovered.

    Output, one row per cell: keys, ``_row``, ``header``, ``value``, ``span``
    (rows merged into a non-blank cell, NULL on blank cells), ``covered``
    (the cell is merged into one above) and ``filled`` (the value shown
    after un-merging: the covering cell's value, '' when uncovered).

    One shuffle of sheet rows: all columns' windows run over the same
    partitions, one per bucket of ``bucket_rows`` row numbers, in one order,
    and the sheet is unpivoted at the end.  What a bucket hands on (its rows,
    per column the place of its first and the value of its last non-blank
    cell) is a summary ``bucket_rows`` times smaller than the data; it reads
    the same exchange and is joined back by size."""
    keys = list(sheet_keys)
    s = Slots(sheet, [row_col, *keys])
    headers = list(headers or s.headers)
    key_names = [f"__key{i}" for i in range(len(keys))]
    places = range(len(headers))
    rows = s.df.select(*[s.own(k).alias(n) for k, n in zip(keys, key_names)], s.own(row_col).alias("__row"),
                       F.floor(s.own(row_col) / F.lit(bucket_rows)).alias("__b"),
                       *[s.col(h).alias(f"__v{i}") for i, h in enumerate(headers)])
    part = [*key_names, "__b"]
    w = Window.partitionBy(*part).orderBy("__row")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # The cell if it is not blank.
    shown = [F.when(js_trim(F.coalesce(F.col(f"__v{i}"), F.lit(""))) != "", F.col(f"__v{i}")) for i in places]
    # Dealt out here so that cells and summary read one and the same exchange.
    rows = rows.repartition(*part).select("*", *[c.alias(f"__s{i}") for i, c in zip(places, shown)])
    ranked = rows.withColumn("__rank", F.row_number().over(w))
    d = ranked.select("*", *[F.last(f"__s{i}", ignorenulls=True).over(upto).alias(f"__head{i}") for i in places],
                      *[F.expr(f"lead(IF(__s{i} IS NULL, NULL, __rank)) IGNORE NULLS").over(w).alias(f"__next{i}")
                        for i in places])

    rank_shown = [F.when(F.col(f"__s{i}").isNotNull(), F.col("__rank")) for i in places]
    edges = ranked.groupBy(*part).agg(
        F.max("__rank").alias("__n"),
        *[F.max_by(f"__s{i}", r).alias(f"__last{i}") for i, r in zip(places, rank_shown)],
        *[F.min(r).alias(f"__first{i}") for i, r in zip(places, rank_shown)])
    whole = Window.partitionBy(*key_names or [F.lit(0)]).orderBy("__b")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = edges.select("*", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows_before"),
                         F.sum("__n").over(every).alias("__total"),
                         *[F.last(f"__last{i}", ignorenulls=True).over(before).alias(f"__carried{i}") for i in places])
    carry = carry.select(
        *part, "__rows_before", "__total", *[f"__carried{i}" for i in places],
        *[F.expr(f"lead(__rows_before + __first{i}) IGNORE NULLS").over(whole).alias(f"__later{i}") for i in places])

    j = d.join(carry, part, "left")

    def cell(i: int, header: str) -> Column:
        head = F.coalesce(F.col(f"__head{i}"), F.col(f"__carried{i}"))
        filled = F.col(f"__s{i}").isNotNull()
        until = F.coalesce(F.col(f"__next{i}") + F.col("__rows_before"), F.col(f"__later{i}"), F.col("__total") + 1)
        return F.struct(
            F.lit(header).alias("header"), F.col(f"__v{i}").alias("value"),
            F.when(filled, until - F.col("__rank") - F.col("__rows_before")).cast("long").alias("span"),
            (head.isNotNull() & ~filled).alias("covered"), F.coalesce(head, F.lit("")).alias("filled"))
    return j.select(*[F.col(n).alias(k) for k, n in zip(keys, key_names)], F.col("__row").alias(row_col),
                    F.inline(F.array(*[cell(i, h) for i, h in enumerate(headers)])))


def fill_down(sheet: DataFrame, headers: Sequence[str] | None = None, row_col: str = "_row",
              sheet_keys: Sequence[str] = (), bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Value view of ``merge_spans``: every blank cell takes the last
    non-blank value above it in its column (leading blanks stay '')."""
    spans = merge_spans(sheet, headers, row_col, sheet_keys, bucket_rows)
    return spans.select(*sheet_keys, row_col, "header", "filled")
