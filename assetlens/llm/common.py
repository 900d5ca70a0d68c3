"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.session import shared_table  # noqa: F401 - for the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Words of the similarity operators: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Entries a worker keeps in a per-word cache before it starts afresh.
CACHE_ENTRIES = 300_000


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.  Spark deletes them when
    the driver's JVM collects the plans that made them; a long job asks for
    that between its steps, so that its disk holds one step's files.  The JVM
    learns within about a second which frames Python has let go of, so it is
    asked after that."""
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(doc_id: Column) -> Column:
    """The document id as text; a null id reads as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def held_out(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id's text leaves no remainder by ``folds``."""
    return F.crc32(id_text(doc_id).cast("binary")) % folds == 0


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8.  ``bytes.lower`` and
    ``bytes.split`` treat ASCII letters and ASCII white space only, which is
    what WORD_PATTERN asks for."""
    return text.encode("utf-8").lower().split() if text else []


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes hashed at once; a longer word is hashed whole.
SLICE_BYTES = 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly over their range (a bijection)."""
    values = (values ^ (values >> _SHIFT)) * _MIX
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> _SHIFT)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    return tuple(np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size, base)))) for base in
                 (_ODD, _INVERSE))


def _slices(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of slices that end at white space."""
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut + 1 if cut >= at else data.find(b" ", end) + 1
        yield at, min(end, len(data))
        at = end


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): 64-bit hashes of the words of all texts, one text after
    another, and where each text's words end.

    Words are those of ``words_of``.  Each is hashed as a polynomial of its
    bytes modulo 2**64, taken as a difference of running sums, then mixed with
    its length: a few array operations for all words of many texts.
    """
    parts = [t.encode("utf-8").lower() if t else b"" for t in texts]
    lasts = np.cumsum([len(p) + 1 for p in parts])
    data = b" ".join(parts) + b" "
    hashes, places = [], []
    for begin, end in _slices(data):
        codes = np.frombuffer(data, np.uint8, end - begin, begin)
        space = _SPACE[codes]
        size = SLICE_BYTES if len(codes) <= SLICE_BYTES else len(codes)
        powers, inverses = _powers(size)
        sums = np.empty(len(codes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:len(codes)], out=sums[1:])
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        first, last = edge[0::2], edge[1::2]
        own = (sums[last] - sums[first]) * inverses[first]
        hashes.append(mixed(own + (last - first).astype(np.uint64) * _MIX))
        places.append(first + begin)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64),
            np.searchsorted(np.concatenate(places), lasts) if places else np.zeros(len(texts), np.int64))


def text_groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about SLICE_BYTES characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= SLICE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text, the 64-bit hashes of its ``width``-word shingles in text
    order, repeats included; a shorter text has one shingle, its whole
    sequence; no words, none."""
    for group in text_groups(texts):
        words, ends = word_hashes(group)
        n = max(len(words) - width + 1, 0)
        rolled = np.full(n, np.uint64(width))
        for k in range(width):
            rolled = rolled * _ODD + words[k:k + n]
        rolled = mixed(rolled)
        start = 0
        for end in ends.tolist():
            if end - start >= width:
                yield rolled[start:end - width + 1]
            elif end > start:
                short = np.full(1, np.uint64(end - start))
                for word in words[start:end]:
                    short = short * _ODD + word
                yield mixed(short)
            else:
                yield words[:0]
            start = end


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort is faster here than ``np.unique``)."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text, its sorted distinct shingle hashes."""
    return map(distinct, shingles(texts, width))


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of each Arrow batch whose first columns are id and text."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_pylist(), batch.column(1).to_pylist()
