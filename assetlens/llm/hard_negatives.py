"""Hard-negative mining with an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own (k-means on a
bounded sample); a pair of codewords is a cell.  The index table holds every
distinct (vector, label) once, with its smallest ids, range partitioned by
cell.  A task reads the index in blocks of rows and searches each block for
every query: a multi-sequence heap visits the cells by the sum of the halves'
score bounds, a half-space inner product plus the codeword's radius in the
block.  The search of a block ends when no cell left can enter a result, so
the results are exact whatever the codebooks are.

Queries, a stated share of the rows, go out in broadcast blocks of bounded
size, equal ones once; each block of them reads the index twice, first for
the positives, then for the score windows that these set.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.session import drop_shared

from .common import shared_table

#: A component counts as floor(SCALE * x).
SCALE = 256
#: Positives of an anchor, negatives of a positive, and the window of a
#: negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90

#: Rows that the codebooks are fitted on (the first in hash order of their
#: ids), codewords of each half, k-means rounds.
SAMPLE = 20_000
CODEWORDS = 32
ROUNDS = 10

#: Queries broadcast at once, index rows searched at once, rows scored at once.
QUERY_BLOCK = 20_000
INDEX_BLOCK = 65_536
SCORED = 1_024

#: What one product may sum to when floating-point products are exact.
EXACT = float(1 << 53)


@dataclass
class Codebooks:
    """Codewords of the first ``cut`` components and of the others."""

    width: int
    cut: int
    first: np.ndarray
    second: np.ndarray

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, :self.cut], self.first), _nearest(x[:, self.cut:], self.second)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1) - 2.0 * (x.astype(np.float64) @ words.T), axis=1)


def _k_means(x: np.ndarray, codewords: int, rounds: int) -> np.ndarray:
    """Codewords of the rows of ``x``: distinct rows spread over the sample to
    begin with, then means."""
    words = np.unique(x.astype(np.float64), axis=0)
    words = words[np.linspace(0, len(words) - 1, min(codewords, len(words))).astype(int)]
    for _ in range(rounds):
        own = _nearest(x, words)
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(words))
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an integer matrix; shorter rows end in 0."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector (whole numbers) of the rows that take part: id
    and label set, every component set and finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("vector")))


def fit_codebooks(rows: DataFrame, sample: int = SAMPLE, codewords: int = CODEWORDS,
                  rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the halves, from ``sample`` rows at most."""
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 2)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    x = matrix(some.column(0).combine_chunks(), width) if some.num_rows else np.zeros((1, width))
    cut = width // 2
    return Codebooks(width, cut, _k_means(x[:, :cut], codewords, rounds), _k_means(x[:, cut:], codewords, rounds))


def build_index(rows: DataFrame, books: Codebooks, ids: int = NEGATIVES) -> DataFrame:
    """The index table: code1, code2, label, vector, ids.

    Rows of one vector and label have one score for any query, so only the
    ``ids`` smallest of their ids can be among the first ``ids`` rows of a
    result; the window drops the others before the shuffle already.
    """
    same = Window.partitionBy("vector", "label").orderBy("vec_id")
    groups = (rows.withColumn("nth", F.dense_rank().over(same)).filter(F.col("nth") <= ids)
              .groupBy("vector", "label").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = books.codes(matrix(batch.column(0), books.width))
            yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)),
                                              *batch.columns], ["code1", "code2", "vector", "label", "ids"])

    coded = groups.select("vector", "label", "ids").mapInArrow(
        assign, "code1 int, code2 int, vector array<long>, label long, ids array<long>")
    return shared_table(coded.repartitionByRange("code1", "code2", "label", F.col("ids")[0]), "negatives-index")


class CellBlock:
    """Index rows in memory, ordered by cell and label."""

    def __init__(self, table: pa.Table, books: Codebooks):
        code1, code2, label = (table.column(k).to_numpy().astype(np.int64) for k in (0, 1, 3))
        order = np.lexsort((label, code2, code1))
        table = table.take(pa.array(order)).combine_chunks()
        self.books, self.label = books, label[order]
        self.x = matrix(table.column(2).combine_chunks(), books.width)
        ids = table.column(4).combine_chunks()
        self.offsets, self.ids = ids.offsets.to_numpy(), ids.flatten().to_numpy()
        self.most = float(np.abs(self.x).max(initial=0))
        self.wide = self.x.astype(np.float64)
        codes = np.stack((code1[order], code2[order]), 1)
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(1)])
        ends = np.r_[starts[1:], len(codes)]
        self.cells = {(a, b): (s, e) for (a, b), s, e in zip(codes[starts].tolist(), starts.tolist(), ends.tolist())}
        self.used = [np.unique(codes[:, k]) for k in (0, 1)]
        words = books.first[codes[:, 0]], books.second[codes[:, 1]]
        halves = self.wide[:, :books.cut], self.wide[:, books.cut:]
        self.radii = []
        for k in (0, 1):
            radius = np.zeros(len((books.first, books.second)[k]))
            np.maximum.at(radius, codes[:, k], np.sqrt(((halves[k] - words[k]) ** 2).sum(1)))
            self.radii.append(radius)

    def by_bound(self, q: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper, lower, start, end): the cells and bounds of their scores,
        greatest upper bound first, from a heap over both sorted halves."""
        cut, sides = self.books.cut, []
        for k, (words, half) in enumerate(((self.books.first, q[:cut]), (self.books.second, q[cut:]))):
            used = self.used[k]
            spread = np.sqrt((half * half).sum()) * self.radii[k][used]
            upper = words[used] @ half + spread
            order = np.argsort(-upper)
            sides.append((upper[order].tolist(), (2 * spread[order]).tolist(), used[order].tolist()))
        (up1, spread1, word1), (up2, spread2, word2) = sides
        heap = [(-(up1[0] + up2[0]), 0, 0)]
        while heap:
            negative, i, j = heapq.heappop(heap)
            if j + 1 < len(up2):
                heapq.heappush(heap, (-(up1[i] + up2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(up1):
                heapq.heappush(heap, (-(up1[i + 1] + up2[0]), i + 1, 0))
            cell = self.cells.get((word1[i], word2[j]))
            if cell:
                slack = 1e-9 * (1.0 + abs(negative) + spread1[i] + spread2[j])
                yield -negative + slack, -negative - spread1[i] - spread2[j] - slack, *cell

    def of_label(self, start: int, end: int, label: int) -> tuple[int, int]:
        """The rows of a label inside a cell."""
        return (start + int(np.searchsorted(self.label[start:end], label)),
                start + int(np.searchsorted(self.label[start:end], label, "right")))

    def scores(self, spans: list[tuple[int, int]], q: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of spans of rows; exact whole numbers."""
        rows = np.concatenate([np.arange(s, e) for s, e in spans])
        if self.most * np.abs(q).max(initial=0) * len(q) < EXACT:
            return rows, (self.wide[rows] @ q).astype(np.int64)
        return rows, self.x[rows] @ whole

    def rows_of(self, rows: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """(-score, id) of all ids kept for these index rows."""
        return [(-s, i) for r, s in zip(rows.tolist(), scores.tolist())
                for i in self.ids[self.offsets[r]:self.offsets[r + 1]].tolist()]


class Best:
    """The first ``size`` rows by score and id whose scores lie in a window."""

    def __init__(self, size: int, low: int | None = None, high: int | None = None):
        self.size, self.low, self.high = size, low, high
        self.rows: list[tuple[int, int]] = []

    def wants(self, upper: float, lower: float) -> bool:
        """Whether a score between these bounds could enter."""
        return upper >= self.floor() and (self.high is None or lower <= self.high)

    def floor(self) -> float:
        """No score below this can enter, now or later."""
        least = -float("inf") if self.low is None else self.low
        return max(least, -self.rows[-1][0]) if len(self.rows) == self.size else least

    def offer(self, block: CellBlock, rows: np.ndarray, scores: np.ndarray) -> None:
        fits = scores >= self.floor()
        if self.high is not None:
            fits &= scores <= self.high
        rows, scores = rows[fits], scores[fits]
        if len(rows) > self.size:
            near = scores >= np.partition(scores, len(scores) - self.size)[len(scores) - self.size]
            rows, scores = rows[near], scores[near]
        if len(rows):
            self.rows = heapq.nsmallest(self.size, set(self.rows + block.rows_of(rows, scores)))


def search(block: CellBlock, whole: np.ndarray, label: int, same: bool, bests: list[Best]) -> None:
    """Offer the block's rows of the label (or of all others) to ``bests``,
    cell by cell, until no cell left can change any of them."""
    q = whole.astype(np.float64)
    bests = [best for best in bests if best.high is None or best.low <= best.high]
    spans, count = [], 0

    def score() -> None:
        if count:
            rows, scores = block.scores(spans, q, whole)
            for best in bests:
                best.offer(block, rows, scores)

    for upper, lower, start, end in block.by_bound(q):
        if all(upper < best.floor() for best in bests):
            break
        if not any(best.wants(upper, lower) for best in bests):
            continue
        a, b = block.of_label(start, end, label)
        for s, e in [(a, b)] if same else [(start, a), (b, end)]:
            if e > s:
                spans.append((s, e))
                count += e - s
        if count >= SCORED:
            score()
            spans, count = [], 0
    score()


def window(positive: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """Smallest and greatest score s with least * positive <= 100 * s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


def _searched(index: DataFrame, books: Codebooks, queries: pa.Table, make: Callable[[tuple], list[Best]],
              same: bool) -> DataFrame:
    """Per task, query and result: gid, positive_score, vec_id, score.

    ``queries`` (gid, vector, label, scores) is one block of queries; ``make``
    gives the results that a query wants, one per positive score.
    """
    sent = index.sparkSession.sparkContext.broadcast(
        (queries.column(0).to_pylist(), matrix(queries.column(1).combine_chunks(), books.width),
         queries.column(2).to_pylist(), queries.column(3).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gids, vectors, labels, wanted = sent.value
        found = [make(w) for w in wanted]
        held, size = [], 0

        def take() -> None:
            block = CellBlock(pa.Table.from_batches(held), books)
            for k, bests in enumerate(found):
                search(block, vectors[k], labels[k], same, bests)

        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_BLOCK):
                part = batch.slice(at, INDEX_BLOCK)
                if held and size + part.num_rows > INDEX_BLOCK:
                    take()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            take()
        for k, bests in enumerate(found):
            rows = [(gids[k], p, i, -s) for p, best in zip(wanted[k] or [None], bests) for s, i in best.rows]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["gid", "positive_score", "vec_id", "score"])

    return index.mapInArrow(run, "gid long, positive_score long, vec_id long, score long")


def _first(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The first ``size`` rows of each result over all tasks, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def _blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries, QUERY_BLOCK of them at a time."""
    numbers = queries.agg(F.max("block")).first()[0]
    for k in range(0 if numbers is None else numbers + 1):
        yield queries.filter(F.col("block") == k).select("gid", "vector", "label", "scores").toArrow()


def _in_blocks(queries: DataFrame, gid: Column) -> DataFrame:
    """Number rows ``gid`` and deal them to blocks of about QUERY_BLOCK."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    return queries.withColumn("gid", gid).withColumn("block", F.pmod(F.xxhash64("vector", "label"), F.lit(blocks)))


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("gid", "positive_score", "vec_id", "score")])
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST, books: Codebooks | None = None) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding (array of numbers) and label; further
    columns are not read.  ``anchors`` is a condition on vec_id.  Scores are
    whole inner products of floor(256 x); ties go to the smaller id.  An
    anchor's positives are its first ``positives`` other rows of its label;
    their negatives the first ``negatives`` rows of other labels whose scores
    are ``least`` to ``most`` hundredths of the positive's.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part.  Vectors of different lengths meet as if the
    shorter ended in zeros, an empty vector scores 0.  Repeated rows count
    once; rows of one id with other vectors or labels are rows of their own, each
    may be found, but an anchor of their id passes them over among its first
    ``positives`` + 1 rows.  A negative or zero positive score
    has an empty window, or the score 0 alone.  Scores are exact while they
    fit 64 bits.  Very long vectors only cost their length.  An empty table
    gives no rows.
    """
    rows = shared_table(usable(vectors), "negatives-rows")
    books = books or fit_codebooks(rows)
    index = build_index(rows, books, max(negatives, positives + 1))
    anchor_rows = rows.filter(anchors)
    queries = shared_table(_in_blocks(anchor_rows.select("vector", "label").distinct(), F.monotonically_increasing_id())
                           .withColumn("scores", F.array().cast("array<long>")), "negatives-queries")

    parts = [shared_table(_searched(index, books, block, lambda _: [Best(positives + 1)], True), "negatives-positives")
             for block in _blocks(queries)]
    nearest = shared_table(_first(_union(parts, rows.sparkSession), ["gid"], positives + 1)
                           .select("gid", "vec_id", "score"), "negatives-nearest")
    for part in parts:
        drop_shared(part)

    wanted = nearest.groupBy("gid").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    asked = queries.drop("scores").join(wanted, "gid")
    parts = [shared_table(_searched(index, books, block,
                                    lambda ps: [Best(negatives, *window(p, least, most)) for p in ps], False),
                          "negatives-found") for block in _blocks(asked)]
    found = _first(_union(parts, rows.sparkSession), ["gid", "positive_score"], negatives)

    own = anchor_rows.distinct().join(queries.select("gid", "vector", "label"), ["vector", "label"]).select(
        F.col("vec_id").alias("anchor_id"), "gid")
    order = Window.partitionBy("anchor_id", "gid").orderBy(F.desc("score"), "vec_id")
    pairs = (own.join(nearest, "gid").filter(F.col("vec_id") != F.col("anchor_id"))
             .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives)
             .select("anchor_id", "gid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    return pairs.join(found, ["gid", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
