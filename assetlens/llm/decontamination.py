"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are parted by their number of shingles into classes [m, 2m), and
documents are read in windows whose width fits the class (4m shingles, a step
of 2m), so a short item is never compared with the whole of a long document.
A window and an item of its class are a candidate when any of PERMUTATIONS
minima agree; with the lowest Jaccard similarity that a containment of 0.8
leaves in such a window (0.19), 64 minima miss one in about 700,000.  Each
candidate is verified by exact containment of the item's shingles in the
whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, mixed, shingle_sets, shingles, text_batches, text_groups, word_hashes, words_of

WIDTH = 5
THRESHOLD = 80
PERMUTATIONS = 64
#: Items of one pass over the documents.  A larger test set takes several
#: passes, block after block, so what travels to the tasks stays bounded.
ITEM_BLOCK = 20_000
#: Shingles hashed at once.
SLICE = 1 << 16

SCHEMA = "doc_id long, item_id long, shared long, item_shingles long, containment double"

_EMPTY = np.uint32(0xFFFFFFFF)


def permutations(count: int = PERMUTATIONS) -> np.ndarray:
    """Odd multipliers of the hash permutations, fixed."""
    return (mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)) & np.uint64(0xFFFFFFFF)


def permuted(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One row per shingle: its 32-bit hash under each permutation."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = low[:, None] * multipliers.astype(np.uint32)[None, :]
    return out ^ (out >> np.uint32(15))


def word_counts(texts: list[str | None]) -> Iterator[int]:
    for group in text_groups(texts):
        _, ends = word_hashes(group)
        yield from np.diff(np.concatenate(([0], ends))).tolist()


class ItemIndex:
    """Signatures and shingles of a block of test items, by size class."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: int = THRESHOLD):
        self.multipliers = permutations()
        self.threshold = threshold
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        classes: dict[int, list[int]] = {}
        # Items of fewer words than a shingle are word runs of their own length.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = [len(words_of(text)) for _, text in items]
        for size in sorted({n for n in sizes if 0 < n < WIDTH}):
            own = [item for item, n in zip(items, sizes) if n == size]
            hashes = np.concatenate(list(shingles([text for _, text in own], size)))
            order = np.argsort(hashes, kind="stable")
            self.short[size] = hashes[order], len(self.ids) + order
            self.ids += [item_id for item_id, _ in own]
            self.sets += list(hashes[:, None])
        items = [item for item, n in zip(items, sizes) if n >= WIDTH]
        for (item_id, _), own in zip(items, shingle_sets([text for _, text in items], WIDTH)):
            if len(own):
                classes.setdefault(len(own).bit_length() - 1, []).append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(own)
        # Per class: a bitmap of low bits of the minima, and behind it the
        # sorted keys (permutation, minimum) with their items.
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for level, members in classes.items():
            minima = np.stack([permuted(self.sets[i], self.multipliers).min(axis=0) for i in members])
            columns = np.arange(minima.shape[1], dtype=np.uint64)
            keys = self.keys(columns[None, :], minima).ravel()
            behind = np.repeat(np.array(members), minima.shape[1])
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << max(18, (16 * len(keys)).bit_length()), bool)
            bitmap[minima & np.uint32(len(bitmap) - 1)] = True
            self.classes[level] = bitmap, keys[order], behind[order]

    @staticmethod
    def keys(columns: np.ndarray, minima: np.ndarray) -> np.ndarray:
        return (columns.astype(np.uint64) << np.uint64(32)) | minima.astype(np.uint64)

    def candidates(self, document: np.ndarray) -> set[int]:
        """Items of which some window of the document shares a minimum.

        Tiles of 2 shingles are reduced first; each larger class halves the
        number of tiles, and a window is two neighbouring tiles.
        """
        found: set[int] = set()
        if not len(document) or not self.classes:
            return found
        parts = []
        for at in range(0, len(document), SLICE):
            rows = permuted(document[at:at + SLICE], self.multipliers)
            if len(rows) % 2:
                rows = np.vstack([rows, np.full((1, rows.shape[1]), _EMPTY)])
            parts.append(np.minimum(rows[0::2], rows[1::2]))
        tiles = np.vstack(parts)
        for level in range(max(self.classes) + 1):
            if level:
                if len(tiles) % 2:
                    tiles = np.vstack([tiles, np.full((1, tiles.shape[1]), _EMPTY)])
                tiles = np.minimum(tiles[0::2], tiles[1::2])
            if level in self.classes:
                windows = np.minimum(tiles[:-1], tiles[1:]) if len(tiles) > 1 else tiles
                bitmap, known, behind = self.classes[level]
                rows, columns = np.nonzero(bitmap[windows & np.uint32(len(bitmap) - 1)])
                keys = np.unique(self.keys(columns, windows[rows, columns]))
                first, last = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                for a, b in zip(first[last > first], last[last > first]):
                    found.update(behind[a:b].tolist())
        return found

    def links_of(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int]]]:
        """Per text its (item, shared shingles, item's shingles)."""
        found = [list(self.links(document)) for document in shingles(texts, WIDTH)]
        for size, (known, behind) in self.short.items():
            for links, words, document in zip(found, word_counts(texts), shingles(texts, size)):
                if words >= size:  # a shorter text is one shingle of its own
                    own = distinct(document)
                    first, last = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
                    links += [(i, 1, 1) for a, b in zip(first[last > first].tolist(), last[last > first].tolist())
                              for i in behind[a:b].tolist()]
        yield from found

    def links(self, document: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, shared shingles, item's shingles) of verified items."""
        candidates = self.candidates(document)
        if candidates:
            own = np.unique(document)
            for i in sorted(candidates):
                shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                if 100 * shared >= self.threshold * len(self.sets[i]):
                    yield i, shared, len(self.sets[i])


def item_blocks(benchmark: DataFrame, item_block: int) -> Iterator[list[tuple[int, str | None]]]:
    """The test items, at most about ``item_block`` at a time; one empty block
    if there are none."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("length(text) > 0")
    blocks = max(-(-items.count() // item_block), 1)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _search(docs: DataFrame, items: list[tuple[int, str | None]], threshold: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, threshold)
        for ids, texts in text_batches(batches):
            rows = [(doc_id, index.ids[i], shared, size, shared / size)
                    for doc_id, links in zip(ids, index.links_of(texts)) for i, shared, size in links]
            names = ["doc_id", "item_id", "shared", "item_shingles", "containment"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=names)

    return docs.mapInArrow(search, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD,
                  item_block: int = ITEM_BLOCK) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text) where
    the document holds ``threshold`` per cent of the item's distinct five-word
    shingles or more: doc_id, item_id, shared, item_shingles, containment.

    Words are A-Z lower-cased.  An item of fewer than five words is one
    shingle, found where its words stand together in a text; a document of
    fewer than five words can only hold such items; null and empty texts are linked with nothing; repeated rows
    repeat their pairs; empty tables give no rows; further columns are not
    read.  All documents are searched for the items in blocks of
    ``item_block``; documents are never shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_search(docs, items, threshold) for items in item_blocks(benchmark, item_block)]
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD,
                      item_block: int = ITEM_BLOCK) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; all columns
    stay.  Rows are judged and kept where they are read, without a join."""
    def clean(items):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items, threshold)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not links for links in index.links_of(texts)], pa.bool_()))
        return keep

    for items in item_blocks(benchmark, item_block):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs
