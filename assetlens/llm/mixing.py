"""Mixing sources to target weights by systematic sampling (DataFrame only).

Every document of a source is expected ``target / source_size`` times.  The
expected copies are prefix-summed in a fixed order of the source, one offset
per source is added, and a document is taken once for each integer the sum
crosses at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, id_text

#: Weights of the sources by code point (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_COPIES = 2.0
#: Buckets of ids inside a size class: a class that holds most of a source
#: still spreads over many tasks.
BUCKETS = 256
#: Size classes per doubling of the size.
CLASSES_PER_DOUBLING = 4


def _digest(text: Column, digits: int) -> Column:
    """The first hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
                   max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    The water level L solves sum(min(cap, weight * L)) = total.  Sources
    ordered by cap / weight fill up first; with the caps of the sources before
    and the weights from each on, the first source whose own level is not
    above its ratio gives L, and later sources' levels only fall, so L is the
    largest of them.  One row per source is all these windows see.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (rank % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(max_copies))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(total_share)
    levels = capped.withColumn("level", (total - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    return levels.withColumn("water", level).select(
        "source", "source_size",
        F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water")))
        .alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: float = MAX_COPIES,
        seed: str = "mix") -> DataFrame:
    """``docs`` plus size, source_size, target, copies and taken (words).

    Documents of a source stand in order of (size class, id bucket, size,
    id), so equal shares of every size are taken.  Only counts per (source,
    class, bucket) meet in one task; a source that holds most rows is ranked
    bucket by bucket.  Null texts have size 0, null sources are one source,
    rows with equal keys are interchangeable (ties, repeated rows), and an
    empty table gives none.  A very long text counts its words like any other.
    Columns of those names in ``docs`` are replaced.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    keyed = docs.select(*own, size.alias("size")).withColumns({
        "__source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
        "__class": F.floor(F.log2(F.col("size") + F.lit(1.0)) * CLASSES_PER_DOUBLING).cast("int"),
        "__bucket": (_digest(id_text(F.col("doc_id")), 6) % BUCKETS).cast("int"),
    })
    cells = keyed.groupBy("__source", "source", "__class", "__bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sizes = cells.groupBy("__source", "source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, total_share, max_copies).withColumn(
        "__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    up_to = (Window.partitionBy("__source").orderBy("__class", "__bucket")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select("__source", "__class", "__bucket",
                           F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("__before"))
    in_cell = Window.partitionBy("__source", "__class", "__bucket").orderBy("size", "doc_id")
    placed = (keyed.withColumn("__rank", F.row_number().over(in_cell))
              .join(offsets, ["__source", "__class", "__bucket"]).join(targets, "__source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _digest(F.concat(F.lit(seed + ":"), F.col("__source")), 5) / F.lit(float(16 ** 5))
    place = (F.col("__before") + F.col("__rank")).cast("double")
    copies = (F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)).cast("long")
    return placed.select(*own, "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, numbered by ``copy`` from 1."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
