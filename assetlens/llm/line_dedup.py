"""Line dedup: lines that many documents share.

A line's key is the line without ASCII white space at both ends, A-Z
lower-cased.  Each task turns its texts into rows (128-bit hash of the key,
document, places of the lines), one per key and document.  The rows are range
partitioned on (hash, document) and sorted, so that a task streams the
documents of a hash in order and counts first occurrences; a hash that holds
a third of all lines is dealt over many tasks, since the document belongs to
the range.  What a task cannot decide alone are the hashes at its two edges:
their counts are added up in a small aggregate.  The lines to drop return as
one compressed keep bitmap per document; texts are only read again to apply
it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.session import drop_shared

from .common import shared_table

#: Shortest key, in code points, and documents from which on a key is shared.
MIN_CHARS = 1
MIN_DOCS = 10

BLANKS = b" \t\n\v\f\r"
KEYS = "hi long, lo long, doc_id long, text_key long, places binary"
DROPS = KEYS + ", n_docs long, kind string"
BITMAPS = "doc_id long, text_key long, n_dropped long, keep binary"


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, null flags) of an integer column; null counts as 0."""
    return (column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            column.is_null().to_numpy(zero_copy_only=False))


def key_rows(min_chars: int):
    """Arrow function: (doc_id, text_key, text) to one KEYS row per document
    and key; ``places`` are the key's line numbers as 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, places = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                found: dict[bytes, list[int]] = {}
                for place, line in enumerate((text or "").encode("utf-8").lower().split(b"\n")):
                    key = line.strip(BLANKS)
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8")) >= min_chars):
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(place)
                digests += found
                rows += [row] * len(found)
                places += [np.array(p, "<u4").tobytes() for p in found.values()]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(taken),
                 batch.column(1).take(taken), pa.array(places, pa.binary())],
                ["hi", "lo", "doc_id", "text_key", "places"])

    return run


class _Stream:
    """State of one task that reads sorted KEYS rows: the open hash, its last
    document, how many documents it has, and the rows not decided yet (fewer
    than ``min_docs``)."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.key = self.doc = self.first = None
        self.count, self.held, self.leading = 0, [], True
        self.out: list[tuple] = []

    def emit(self, row: tuple, kind: str, first: bool) -> None:
        places = row[4][4:] if first and self.keep_first and kind == "drop" else row[4]
        if places:
            self.out.append((*row[:4], places, None, kind))

    def close(self, edge: bool) -> None:
        """Decide the open hash; one at an edge of the task leaves what it
        cannot know to the aggregate over all edges."""
        if self.key is None:
            return
        edge = edge or self.leading
        shared = self.count >= self.min_docs
        for k, row in enumerate(self.held):
            unknown_first = k == 0 and self.leading and self.keep_first
            if shared and not unknown_first:
                self.emit(row, "drop", k == 0)
            elif edge:
                self.emit(row, "open", False)
        if edge:
            self.out.append((*self.first[:4], None, self.count, "count"))
        self.leading = False

    def push(self, row: tuple) -> None:
        """The next first occurrence of a hash in a document."""
        if row[:2] != self.key:
            self.close(False)
            self.key, self.first, self.count, self.held = row[:2], row, 0, []
        self.count += 1
        if self.count <= self.min_docs:
            self.held.append(row)
        else:
            self.emit(row, "drop", False)


def shared_keys(min_docs: int, keep_first: bool):
    """Arrow function: KEYS rows in order to DROPS rows.  Kind ``drop`` is
    decided; ``open`` belongs to a hash at the task's edge; ``count`` holds
    the documents that the task counted for such a hash and its first one."""
    names = ["hi", "lo", "doc_id", "text_key", "places", "n_docs", "kind"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(min_docs, keep_first)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*state.out)) or [()] * len(names)
            state.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo = (_numbers(batch.column(k))[0] for k in (0, 1))
            text_key = _numbers(batch.column(3))[0]
            doc, null = _numbers(batch.column(2))
            edge = (hi[0], lo[0]), (doc[0], null[0], text_key[0])
            new_key = np.concatenate(([last is None or last[0] != edge[0]], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            new_doc = new_key | np.concatenate(([last is None or last[1] != edge[1]], (doc[1:] != doc[:-1])
                                                | (null[1:] != null[:-1]) | (text_key[1:] != text_key[:-1])))
            last = (hi[-1], lo[-1]), (doc[-1], null[-1], text_key[-1])
            # a hash that begins and ends inside the batch with too few
            # documents is done: only the others go row by row
            firsts = np.flatnonzero(new_doc)
            run_of = np.cumsum(new_key)[firsts]
            counts = np.bincount(run_of)
            wanted = counts[run_of] >= min_docs
            wanted |= (run_of == run_of[0]) | (run_of == run_of[-1])
            for row in zip(*(c.take(pa.array(firsts[wanted])).to_pylist() for c in batch.columns)):
                state.push(row)
            yield flush()
        state.close(True)
        yield flush()

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 keep_first: bool = False) -> DataFrame:
    """Compressed keep bitmaps of the documents that lose lines: doc_id,
    text_key (64-bit hash of the text), n_dropped, keep.

    ``keep`` is a zlib-compressed bit string, most significant bit first: bit i
    is 0 where line i goes; lines past its end stay.  Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose
    their lines; with ``keep_first`` the first of them, by document and place,
    stays.

    A document is a pair of id and text: repeated rows are one document, rows
    of one id (or of a null id) with different texts are several.  Null and
    empty texts have one empty line, whose key is too short.  Ties cannot
    occur: (hash, document) is unique.  A very long text is one row while it
    is split, then one row per distinct line.  An empty table gives no rows;
    only doc_id and text are read, so further columns may have any name.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    keys = shared_table(own.mapInArrow(key_rows(min_chars), KEYS), "line-keys")
    order = ("hi", "lo", "doc_id", "text_key")
    found = shared_table(keys.repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInArrow(shared_keys(min_docs, keep_first), DROPS), "line-drops")
    drop_shared(keys)
    # at most a few rows per task of the stream
    edges = (found.filter(F.col("kind") == "count").groupBy("hi", "lo")
             .agg(F.sum("n_docs").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("first"))
             .filter(F.col("n") >= min_docs).select("hi", "lo", "first"))
    places = F.col("places")
    if keep_first:
        is_first = F.struct("doc_id", "text_key") == F.col("first")
        places = F.when(is_first, F.expr("substring(places, 5)")).otherwise(places)
    drops = (found.filter(F.col("kind") == "open").join(edges, ["hi", "lo"])
             .select("doc_id", "text_key", places.alias("places"))
             .unionByName(found.filter(F.col("kind") == "drop").select("doc_id", "text_key", "places")))
    return (drops.filter(F.length("places") > 0).groupBy("doc_id", "text_key")
            .agg(F.collect_list("places").alias("places")).mapInArrow(_pack, BITMAPS))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bitmaps = [], []
        for parts in batch.column(2).to_pylist():
            gone = np.frombuffer(b"".join(parts), "<u4")
            keep = np.ones(-(-(int(gone.max()) + 1) // 8) * 8, bool)
            keep[gone] = False
            counts.append(len(gone))
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                                          pa.array(bitmaps, pa.binary())], ["doc_id", "text_key", "n_dropped", "keep"])


def kept_lines(text: str, bitmap: bytes | None) -> tuple[int, bytes]:
    """(lines, kept lines joined by line feeds) of a text under a bitmap."""
    data = text.encode("utf-8")
    if bitmap is None:
        return data.count(b"\n") + 1, data
    lines = data.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).tolist()
    keep += [1] * (len(lines) - len(keep))
    return len(lines), b"\n".join([line for line, k in zip(lines, keep) if k])


def drop_shared_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents under their bitmaps, one row per row of ``docs``: doc_id,
    n_lines (before), n_dropped, kept_text.  Null counts as the empty text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                      F.coalesce("text", F.lit("")).alias("text"))
    b = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key"), "n_dropped", "keep")
    joined = own.join(b, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_lines(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), batch.column(2),
                 pa.array([r[1].decode("utf-8") for r in rows], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return (joined.select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")
            .mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept_text string"))


def line_digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the kept text."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)
                       .alias("kept_sha256"))
