"""N-gram Jaccard self-join: grouped prefix join.

Documents are sets of five-word shingles under one global order: rare
shingles first (by hash), shingles found frequent last, by frequency.  Two
sets with a Jaccard similarity of t share a shingle among their first
``n - ceil(t n) + 1`` (prefix filter).  Documents with one set are one class;
classes with equal prefix and size are one group, and only groups are posted
under their prefix shingles.  Group pairs pass size and position filters, are
expanded to members, and verified on whole sets.

The result needs components, not all pairs, so links are sought in two
rounds.  First each group meets one hub per shingle (the group with most
rows, then most shared shingles) and each member its group's first class, which is linear in the
postings and joins the copies of a text.  Then every remaining pair whose
sides still lie in different components is verified: pairs inside a component
cannot change it, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, shingle_sets, text_batches
from .components import components

WIDTH = 5
THRESHOLD = 80
#: Frequent shingles whose order is by count; further ones are ordered by
#: hash like the rest, which changes work, not results.
FREQUENT = 2_000_000
#: Ids of documents, or pairs of them, to verify that are broadcast (8 bytes an id).
BROADCAST_NODES = 1_000_000
#: Bits of a set's bitmap in the first verification (a power of two).
BITMAP_BITS = 4096
#: Shingles that a task holds while it counts those that repeat.
COUNTED = 1 << 22

PREFIX_SCHEMA = "doc_id long, text_hash long, n long, set_key binary, prefix_key binary, prefix array<long>"


def needed(n: np.ndarray | int, threshold: int):
    """Least overlap of a set of size n with any set that it links to."""
    return -(-threshold * n // 100)


def frequent_shingles(docs: DataFrame, width: int, limit: int | None = None) -> np.ndarray:
    """Shingles that many documents hold, by ascending count.

    A task reports the shingles that repeat within the documents it reads
    together; the counts are summed over all tasks.  What reaches the driver
    is cut at a count that leaves at most ``limit`` (FREQUENT if not given).
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeated() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            return pa.RecordBatch.from_pydict({"shingle": values[many].view(np.int64),
                                               "n": counts[many].astype(np.int64)})
        for _, texts in text_batches(batches):
            for own in shingle_sets(texts, width):
                held.append(own)
                size += len(own)
                if size >= COUNTED:
                    yield repeated()
                    held, size = [], 0
        if held:
            yield repeated()

    counted = shared_table(docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(
        F.sum("n").alias("n")), "frequent")
    least = cut_at(counted, "n", FREQUENT if limit is None else limit)
    rows = counted.filter(F.col("n") >= least).toArrow()
    order = np.lexsort((rows["shingle"].to_numpy(), rows["n"].to_numpy()))
    return rows["shingle"].to_numpy()[order].view(np.uint64)


def cut_at(rows: DataFrame, column: str, limit: int, times: str | None = None) -> int:
    """The least value of a positive whole-number column from which on there
    are at most ``limit`` rows (each counts ``times``, or once), to within an
    eighth of a doubling.  Only one count per eighth reaches the driver."""
    n = F.sum(times) if times else F.count(F.lit(1))
    cells = rows.groupBy(F.floor(F.log2(F.col(column)) * 8).alias("cell")).agg(n.alias("n")).collect()
    total, least = 0, 1 << 62
    for cell in sorted(cells, key=lambda r: -r["cell"]):
        total += cell["n"]
        if total > limit:
            break
        least = int(np.floor(2.0 ** (cell["cell"] / 8)))
        least += least < 2.0 ** (cell["cell"] / 8)
    return least


def prefixes(docs: DataFrame, frequent: np.ndarray, width: int, threshold: int) -> DataFrame:
    """One row per document (doc_id, text, text_hash): size and key of its set,
    and its prefix."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, set_keys, prefix_keys, heads = [], [], [], []
            for own in shingle_sets(batch.column(1).to_pylist(), width):
                n = len(own)
                keep = n - needed(n, threshold) + 1 if n else 0
                at = np.searchsorted(values, own)
                common = values[np.minimum(at, len(values) - 1)] == own if len(values) else np.zeros(n, bool)
                head = own[~common][:keep]
                if len(head) < keep:
                    ranks = np.sort(by_value[at[common]])[:keep - len(head)]
                    head = np.concatenate([head, frequent[ranks]])
                sizes.append(n)
                set_keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                prefix_keys.append(xxhash.xxh3_128_digest(head.tobytes()))
                heads.append(head.view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "text_hash": batch.column(2), "n": pa.array(sizes, pa.int64()),
                "set_key": pa.array(set_keys, pa.binary()), "prefix_key": pa.array(prefix_keys, pa.binary()),
                "prefix": pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(h) for h in heads]))), pa.int32()),
                    pa.array(np.concatenate(heads), pa.int64()))})

    return docs.mapInArrow(cut, PREFIX_SCHEMA)


def repeated_postings(postings: DataFrame) -> DataFrame:
    """The postings (shingle, gid, n, place) whose shingle has at least two.

    A task reads its postings in order of shingle and compares neighbours, so
    a shingle with very many postings streams through it.
    """
    names = ["shingle", "gid", "n", "place"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_repeats = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(4)]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            same = columns[0][1:] == columns[0][:-1]
            repeats = np.zeros(len(columns[0]), bool)
            repeats[0] = held_repeats
            repeats[1:] |= same
            repeats[:-1] |= same
            chosen = np.flatnonzero(repeats[:-1])
            yield pa.RecordBatch.from_pydict({name: c[chosen] for name, c in zip(names, columns)})
            held, held_repeats = [c[-1:] for c in columns], bool(repeats[-1])
        if held is not None and held_repeats:
            yield pa.RecordBatch.from_pydict(dict(zip(names, held)))

    return postings.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(
        keep, "shingle long, gid long, n long, place long")


def may_link(na: Column, pa_: Column, nb: Column, pb: Column, threshold: int) -> Column:
    """Size and position filters of a common shingle at places pa, pb."""
    need = F.floor((F.lit(threshold) * (na + nb) + F.lit(99 + threshold)) / F.lit(100 + threshold))
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold)
            & (F.least(na - pa_, nb - pb) >= need))


def whole_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, bits, shingles) of the documents among ``nodes``: size, bitmap
    of BITMAP_BITS bits, and whole set.

    Few documents are left here.  Up to BROADCAST_NODES ids are sent to where
    the texts are read; beyond that the texts are shuffled to the ids."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            sets = [own.view(np.int64) for own in shingle_sets(texts, width)]
            bits = np.zeros((len(sets), BITMAP_BITS), bool)
            for row, own in zip(bits, sets):
                row[own & (BITMAP_BITS - 1)] = True
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                "bits": pa.array(list(words), pa.list_(pa.int64())),
                "shingles": pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()),
                    pa.array(np.concatenate(sets), pa.int64()))})

    wanted = small(shared_table(nodes.select(F.col("node").alias("doc_id")).distinct(), "nodes"))
    chosen = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    return shared_table(chosen.mapInArrow(read, "node long, n long, bits array<long>, shingles array<long>"), "sets")


def ends_of(pairs: DataFrame) -> DataFrame:
    """(node) of both sides of the pairs."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    Bitmaps go first: a bit that one set has and the other has not stands for
    a shingle that they do not share, which bounds their overlap from above.
    Whole sets are moved for the pairs within that bound only."""
    def side(of: DataFrame, key: str, *columns: str) -> DataFrame:
        return of.select(F.col("node").alias(key), *[F.col(c).alias(c + key) for c in columns])

    def lacking(x: str, y: str):
        bits = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(bits, F.lit(0), lambda acc, n: acc + n)
    sized = small(pairs).join(side(sets, "a", "n", "bits"), "a").join(side(sets, "b", "n", "bits"), "b")
    need = F.floor((F.lit(threshold) * (F.col("na") + F.col("nb")) + F.lit(99 + threshold)) / F.lit(100 + threshold))
    likely = shared_table(sized.filter(F.least(F.col("na") - lacking("bitsa", "bitsb"),
                                               F.col("nb") - lacking("bitsb", "bitsa")) >= need).select("a", "b"), "likely")
    wanted = small(shared_table(ends_of(likely).distinct(), "likely-nodes"))
    chosen = sets.join(wanted, "node", "left_semi")
    both = small(likely).join(side(chosen, "a", "shingles"), "a").join(side(chosen, "b", "shingles"), "b")
    shared = F.size(F.array_intersect("shinglesa", "shinglesb"))
    checked = both.select("a", "b", shared.alias("shared"), (F.size("shinglesa") + F.size("shinglesb")).alias("total"))
    return checked.filter(F.lit(100) * F.col("shared") >= F.lit(threshold) * (F.col("total") - F.col("shared"))).select(
        "a", "b")


def small(table: DataFrame) -> DataFrame:
    """A broadcast of a stored table of ids while its size allows one."""
    return F.broadcast(table) if table.count() <= BROADCAST_NODES else table


def remaining_pairs(postings: DataFrame, members: DataFrame, tried: DataFrame, labels: DataFrame,
                    threshold: int) -> DataFrame:
    """Pairs (a, b) of classes that pass the filters, lie in different
    components and have not been verified yet."""
    placed = shared_table(members.join(labels, "node", "left").select(
        "node", "gid", F.coalesce("component", "node").alias("component")), "placed")
    spans = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    spanned = shared_table(postings.join(spans, "gid"), "spanned")
    open_shingles = (spanned.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h"))
                     .filter("l < h").select("shingle"))
    open_postings = shared_table(spanned.join(open_shingles, "shingle", "left_semi"), "open")
    x, y = open_postings.alias("x"), open_postings.alias("y")
    closed = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (
        F.col("x.low") == F.col("y.low"))
    group_pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.gid") < F.col("y.gid")) & ~closed
                         & may_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), threshold)).select(
        F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct()
    group_pairs = group_pairs.unionAll(spans.filter("low < high").select(F.col("gid").alias("ga"),
                                                                        F.col("gid").alias("gb")))
    left = placed.select(F.col("gid").alias("ga"), F.col("node").alias("a"), F.col("component").alias("ca"))
    right = placed.select(F.col("gid").alias("gb"), F.col("node").alias("b"), F.col("component").alias("cb"))
    expanded = group_pairs.join(left, "ga").join(right, "gb").filter("ca != cb").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return expanded.join(tried, ["a", "b"], "left_anti")


def similar_components(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, itself included).

    Words are A-Z lower-cased.  A set holds the distinct ``width``-word
    shingles; a shorter text is one shingle; null and empty texts have none
    and link with nothing.  Rows with equal sets and ids are one document;
    rows without an id take their copies' component, and with no such copy
    get a null component_id; an empty table gives no rows; further columns
    are not read.  Shingles and sets are compared by 64-bit hashes.
    """
    return _placed(docs, threshold, width).drop("text_hash")


def _placed(docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """``similar_components`` with the hash of each row's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    frequent = frequent_shingles(docs, width)
    rows = shared_table(prefixes(docs, frequent, width, threshold), "prefixes")
    classes = shared_table(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key", "prefix_key", "n").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    groups = classes.groupBy("prefix_key", "n").agg(
        F.min("node").alias("gid"), F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("classes"))
    groups = shared_table(groups, "groups")
    members = shared_table(classes.join(groups, ["prefix_key", "n"]).select("node", "gid", "classes"), "members")

    posted = rows.filter("n > 0").join(groups.select(F.col("gid").alias("doc_id"), "prefix_key"),
                                       ["doc_id", "prefix_key"], "left_semi")
    postings = shared_table(repeated_postings(posted.select(
        F.posexplode("prefix").alias("place", "shingle"), F.col("doc_id").alias("gid"), "n").select(
        "shingle", "gid", "n", F.col("place").cast("long").alias("place"))), "postings")

    # A hub should be the text that others were edited from: it has the most
    # copies, or else the most prefix shingles that others hold as well.
    central = postings.groupBy("gid").agg(F.count(F.lit(1)).alias("held"))
    weighed = postings.join(groups.select("gid", "weight"), "gid").join(central, "gid")
    hubs = weighed.groupBy("shingle").agg(F.max(F.struct("weight", "held", "gid", "n", "place")).alias("hub"))
    to_hub = postings.join(hubs, "shingle").filter(
        (F.col("gid") != F.col("hub.gid"))
        & may_link(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"), threshold)).select(
        F.least("gid", "hub.gid").alias("a"), F.greatest("gid", "hub.gid").alias("b"))
    to_first = members.filter("node != gid").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    tried = shared_table(to_hub.unionAll(to_first).distinct(), "hub-pairs")

    first = components(verified(tried, whole_sets(docs, ends_of(tried), width), threshold), "first-links")
    rest = shared_table(remaining_pairs(postings, members, tried, first, threshold), "rest-pairs")
    links = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(
        verified(rest, whole_sets(docs, ends_of(rest), width), threshold))
    labels = components(links, "links")

    named = classes.join(labels, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component"))
    return rows.join(named, "set_key", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each component, the smallest id's; rows
    without an id stay only where no document with one is similar."""
    kept = _placed(docs, threshold, width).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(kept, (F.xxhash64("text") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")),
                     "left_semi")
