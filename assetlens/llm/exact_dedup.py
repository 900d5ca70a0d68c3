"""Exact deduplication by content-defined chunk recipes (DataFrame only).

A text (A-Z lower-cased) is cut into chunks at places its own content fixes,
chunks are reduced to verified identifiers, and documents are compared by
their ordered identifier lists ("recipes").  Long texts are read in place:
only distinct chunks and short recipes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shared_table

#: A chunk ends after one of these letters followed by white space, no sooner
#: than MIN_CHUNK characters, and at MAX_CHUNK characters at the latest.
MIN_CHUNK = 512
MAX_CHUNK = 8192
BOUNDARY = r"[bdfhklnrt]\s"
#: More colliding hashes than this are not held; another seed is taken.
MAX_COLLIDING = 10_000


def chunks(normalised: Column) -> Column:
    """The text's chunks in order; joined they give the text back."""
    pattern = rf"(?s).{{{MIN_CHUNK - 2},{MAX_CHUNK - 2}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(normalised, F.lit(pattern), F.lit(0))


def colliding_hashes(docs: DataFrame, seed: int) -> list[int]:
    """Hashes that distinct chunk texts share.  Copies of a chunk meet in the
    map-side half of ``distinct``, so a chunk that most documents hold does
    not gather in one task; the second shuffle carries hashes alone."""
    pieces = docs.select(F.explode(chunks(ascii_lower(F.col("text")))).alias("chunk"))
    known = pieces.select(F.xxhash64(F.lit(seed), "chunk").alias("h"), "chunk").distinct()
    shared = known.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return [r["h"] for r in shared.select("h").limit(MAX_COLLIDING + 1).collect()]


def recipe(normalised: Column, seed: int, colliding: list[int]) -> Column:
    """Ordered chunk identifiers as one text.  An identifier is the chunk's
    hash; where different chunks share a hash, the chunk itself follows."""
    def identifier(chunk: Column) -> Column:
        h = F.xxhash64(F.lit(seed), chunk)
        if not colliding:
            return F.hex(h)
        return F.concat(F.hex(h), F.when(h.isin(colliding), F.concat(F.lit("="), F.hex(F.encode(chunk, "UTF-8"))))
                        .otherwise(F.lit("")))
    return F.array_join(F.transform(chunks(normalised), identifier), " ")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id,
    group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal.  Rows without an id
    never win over a row with one; a group of such rows only has a null
    keep_id and all of them are marked kept.  Rows that repeat both id and
    text are one document and share the mark.  No rows give no rows; further
    columns are not read.
    """
    docs = docs.select("doc_id", "text")
    seed, colliding = 0, colliding_hashes(docs, 0)
    while len(colliding) > MAX_COLLIDING:
        seed += 1
        colliding = colliding_hashes(docs, seed)
    normalised = docs.select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    listed = shared_table(normalised.select(
        "doc_id", recipe(F.col("norm"), seed, colliding).alias("recipe"),
        F.sha2(F.col("norm"), 256).alias("text_sha256")), "recipes")
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return listed.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the largest id's;
    all columns stay as they are."""
    kept = exact_groups(docs).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    keyed = docs.withColumn("__sha", F.sha2(ascii_lower(F.col("text")), 256))
    rows = keyed.join(kept.withColumnRenamed("__sha", "__kept_sha"),
                      F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__sha"]).select(*docs.columns)
