"""Language-model scores by a probabilistic suffix tree over words.

Symbols are all words of the training texts and one end of text.  The root
predicts by the smoothed unigram distribution.  A context of one to ``depth``
preceding symbols becomes a state only if its next-symbol counts diverge from
its parent's prediction: the leave-one-out log-likelihood ratio, which noise
makes negative, must exceed MIN_GAIN.  A state's distribution is smoothed by
its parent's, and a text is scored from the longest suffix state at each
place.

A gram of m symbols has a 64-bit number, joined from those of its first and
its last m - 1 symbols.  Each depth is the same step (``deepen``): count the
next symbols of the candidate contexts, keep what occurs more than once
(events seen once only matter by their number, which the context's own count
gives), test the contexts, and pass the events on as candidates of the next
depth.  Rows of all tables are packed: a row holds what one bucket has of
each column, as an array.  Buckets of events ask the level before for what
they need, each gram once, and are answered by bucket.

The log probability of a place is a sum over the grams that end there: the
symbol's unigram log, each state's back-off log, and each event's gain over
both.  So the whole model is one table of weights by gram number, which grows
with the input, and a text's score is the sum of the weights of its grams.
The HOT most frequent weights are broadcast.  The others are looked up in
rounds, each for its share of the grams: what the texts ask for meets the
weights by bucket, and the sums go back to the texts, as packed arrays.  So
the shuffle files of a round are a fraction of all look-ups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.session import drop_shared

from .common import distinct, held_out, mixed, release_shuffles, shared_table, text_groups, word_hashes
from .jaccard_join import cut_at

FOLDS = 10
ADD = 0.1
#: Longest contexts.
DEPTH = 2
#: Least count of a candidate context, least leave-one-out gain (nats) of a state.
MIN_CONTEXT = 4
MIN_GAIN = 2.0
#: Symbols that a task holds while it counts.
COUNTED = 1 << 22
#: Bits of the maps that tell which grams may be in a table (never loses one;
#: others that they let through find nothing in the join).
MAP_BITS = 27
#: Weights that are broadcast (33 bytes each).
HOT = 2_000_000
#: Rounds of the look-ups of the others; look-ups and texts that a task holds
#: until it packs them (a text's place among them has 16 bits).
ROUNDS = 4
ASKED = 1 << 20
ASKING = 1 << 15
#: Bytes of packed rows that a task sends at once.
SENT = 1 << 23
#: Texts that are decoded at once.
PIECE = 500

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Numbers of the start and the end; words have their 64-bit hashes.
START, END = np.uint64(1), np.uint64(0)
#: Packed columns: grams as ``deepen`` takes them and as it gives them, weights.
LEVEL = {"keys": np.uint64, "ns": np.int64, "ps": float, "opens": bool}
DEEPER = LEVEL | {"gains": float, "state_keys": np.uint64, "state_ns": np.int64, "backs": float}
#: A packed table's batches to arrays by column; tables with their readers.
Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]]
Parts = list[tuple[DataFrame, Reader]]
WEIGHTS = {"keys": np.uint64, "ns": np.int64, "weights": float, "knowns": np.int8}


class Lookup:
    """Places of 64-bit keys in a list, as an open-addressing table of arrays:
    thousands of keys are looked up at once, a few array reads each.  The
    table is built, in place of the list, on first use in a worker."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.table = None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "table": None}

    def build(self) -> None:
        size = 1 << max(4, (2 * len(self.keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.table, self.at = np.full(size, self.EMPTY), np.full(size, -1, np.int32)
        slots, left = mixed(self.keys) & self.mask, np.arange(len(self.keys))
        while len(left):
            free = self.table[slots] == self.EMPTY
            self.table[slots[free]] = self.keys[left[free]]
            placed = self.table[slots] == self.keys[left]
            self.at[slots[placed]] = left[placed]
            left, slots = left[~placed], (slots[~placed] + np.uint64(1)) & self.mask
        self.keys = self.keys[:0].copy()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not in the list."""
        if self.table is None:
            self.build()
        slots = mixed(keys) & self.mask
        held = self.table[slots]
        out = np.where(held == keys, self.at[slots], -1)
        left = np.flatnonzero((held != keys) & (held != self.EMPTY))
        slots, keys = slots[left], keys[left]
        while len(left):
            slots = (slots + np.uint64(1)) & self.mask
            held = self.table[slots]
            hit = held == keys
            out[left[hit]] = self.at[slots[hit]]
            more = ~hit & (held != self.EMPTY)
            left, slots, keys = left[more], slots[more], keys[more]
        return out


def joined_id(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit number of a gram from those of its first and last symbols."""
    return mixed(first * ODD + second)


def text_symbols(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per group of texts: their symbols one after another, each text as START,
    words, END, and where each text begins."""
    pieces = (texts.slice(a, PIECE).to_pylist() for a in range(0, len(texts), PIECE))
    for group in (group for piece in pieces for group in text_groups(piece)):
        words, ends = word_hashes(group)
        sizes = np.diff(np.concatenate(([0], ends)))
        begins = np.cumsum(sizes + 2) - sizes - 2
        symbols = np.empty(len(words) + 2 * len(group), np.uint64)
        inner = np.ones(len(symbols), bool)
        inner[begins] = inner[begins + sizes + 1] = False
        symbols[begins], symbols[begins + sizes + 1], symbols[inner] = START, END, words
        yield symbols, begins


def grams(symbols: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, places): the grams of ``size`` symbols inside the texts, and
    the places they end at."""
    numbers, text = symbols, np.zeros(len(symbols), np.int64)
    text[begins] = 1
    text = np.cumsum(text)
    for _ in range(size - 1):
        numbers = joined_id(numbers[:-1], numbers[1:])
    places = np.flatnonzero(text[size - 1:] == text[:len(text) - size + 1])
    return numbers[places], places + size - 1


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the values between every two cuts, which are not copied."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [
        None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def packs(slots: np.ndarray, arrays: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(slots, arrays): one slot a row, with what is in it of each array, from
    arrays in order of slot (which are not copied)."""
    first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])) if len(slots) else np.empty(0, bool))
    cuts = np.append(first, len(slots))
    return slots[first], {k: binaries(v, cuts) for k, v in arrays.items()}


def dealt(slots: np.ndarray, arrays: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """``packs`` of arrays in any order; slots are below 2**16."""
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    return packs(slots[order], {k: v[order] for k, v in arrays.items()})


def packed_schema(columns: Iterable[str]) -> str:
    return ", ".join(f"{c} binary" for c in columns)


def unpacked(table: pa.Table | pa.RecordBatch, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


def one_row(**arrays: np.ndarray) -> dict[str, pa.Array]:
    """Arrays as columns of one packed row."""
    return {k: binaries(v, np.array([0, len(v)])) for k, v in arrays.items()}


def starts(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    n = len(sorted_arrays[0])
    first = np.zeros(n, bool)
    first[:1] = True
    for a in sorted_arrays:
        first[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(first)


def places_of(keys: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """The place of each asked key in sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(ask), -1)
    at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
    return np.where(keys[at] == ask, at, -1)


def slots_for(df: DataFrame) -> int:
    """Slots that the levels are dealt to.  Each bucket of events asks each
    slot, so both are few: a slot holds distinct grams, a bucket those that
    occur more than once."""
    return min(max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4), 1 << 12)


def symbol_packs(training: DataFrame) -> DataFrame:
    """(keys, ns, total, texts) over all training texts, packed: words and the
    end, how often they occur; the sum of the counts and the count of the end."""
    slots = slots_for(training)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            held.clear()
            first = starts(keys)
            n = np.diff(np.append(first, len(keys)))
            at, parts = dealt(keys[first] % np.uint64(slots), {"keys": keys[first], "ns": n})
            return pa.RecordBatch.from_pydict({"slot": pa.array(at.astype(np.int32)), **parts})
        for batch in batches:
            for symbols, _ in text_symbols(batch.column(1)):
                held.append(symbols[symbols != START])
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    def merge(_: tuple, packed: pa.Table) -> pa.Table:
        keys, n = unpacked(packed, "keys", np.uint64), unpacked(packed, "ns", np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        first = starts(keys)
        keys, n = keys[first], np.add.reduceat(n[order], first)
        return pa.table({**one_row(keys=keys, ns=n), "total": [int(n.sum())], "texts": [int(n[keys == END].sum())]})

    return shared_table(training.mapInArrow(count, "slot int, keys binary, ns binary").groupBy("slot").applyInArrow(
        merge, "keys binary, ns binary, total long, texts long"), "lm-symbols")


def in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SENT bytes, so that the JVM holds few."""
    step = max(1, batch.num_rows * SENT // max(batch.nbytes, 1))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def arrays_of(columns: dict) -> Reader:
    """Reads packed columns as they are."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            yield {k: unpacked(batch, k, t) for k, t in columns.items()}
    return read


def mapped(parts: Parts, step: Callable, schema: str) -> DataFrame:
    """``step`` over the arrays of all parts, in one Python function a part."""
    out = None
    for frame, read in parts:
        own = frame.mapInArrow(lambda batches, read=read: step(read(batches)), schema)
        out = own if out is None else out.unionByName(own)
    return out


def rows_of(packed: DataFrame, **columns) -> DataFrame:
    """One row per value of packed long columns, named with their dtypes."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                k: pa.array(unpacked(batch, k, t).view(np.int64) if t is np.uint64 else unpacked(batch, k, t).astype(np.int64))
                for k, t in columns.items()})

    return packed.select(*columns).mapInArrow(unpack, ", ".join(f"{k} long" for k in columns))


def count_symbols(training: DataFrame) -> DataFrame:
    """(key, n) over all training texts: words and the end."""
    return rows_of(symbol_packs(training), keys=np.uint64, ns=np.int64).toDF("key", "n")


#: A place inside a part of the map has 16 bits.
PART_BITS = 16
PLACES = "part int, places binary"


def map_places(keys: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The places of a task's keys in the map, packed by part of the map."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        slots = np.unique(np.concatenate(held))
        held.clear()
        part, parts = packs(slots >> np.uint32(PART_BITS), {"places": slots.astype(np.uint16)})
        return pa.RecordBatch.from_pydict({"part": pa.array(part.astype(np.int32)), **parts})
    for own in keys:
        held.append((own & own.dtype.type((1 << MAP_BITS) - 1)).astype(np.uint32))
        size += len(held[-1])
        if size >= ASKED:
            yield packed()
            size = 0
    if size:
        yield packed()


def united(places: DataFrame) -> np.ndarray:
    """The map of all tasks' ``map_places``: a part is made in one place, and
    the driver gets the 2**MAP_BITS / 8 bytes of the map."""
    def union(key: tuple, packed: pa.Table) -> pa.Table:
        part = np.zeros(1 << PART_BITS, bool)
        for places in packed.column("places").to_pylist():
            part[np.frombuffer(places, np.uint16)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()),
                         "bits": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    rows = places.groupBy("part").applyInArrow(union, "part int, bits binary").toArrow()
    out = np.zeros((1 << (MAP_BITS - PART_BITS), 1 << (PART_BITS - 5)), np.uint32)
    for part, bits in zip(rows["part"].to_pylist(), rows["bits"].to_pylist()):
        out[part] = np.frombuffer(bits, np.uint32)
    return out.reshape(-1)


def key_map(keys: DataFrame) -> np.ndarray:
    """Bits set at the low MAP_BITS bits of every key."""
    return united(keys.mapInArrow(lambda batches: map_places(b.column(0).to_numpy() for b in batches), PLACES))


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64((1 << MAP_BITS) - 1)
    return bits[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1) == 1


def _summed(context: np.ndarray, suffix: np.ndarray, n: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, suffix, n, key) in order of ``key``, neighbours of one context
    and suffix summed."""
    order = np.argsort(key)
    context, suffix = context[order], suffix[order]
    first = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (suffix[1:] != suffix[:-1]))))
    context, suffix = context[first], suffix[first]
    n = np.add.reduceat(n[order], first)
    return context, suffix, n, key[order[first]]


def event_buckets(training: DataFrame) -> int:
    """Buckets that the events are dealt to."""
    return min(max(64, 4 * int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1 << 16)


def large_count(total: int, buckets: int) -> int:
    """Contexts beyond this count, a quarter of a bucket's share, are dealt out
    by gram: at most four times as many as buckets."""
    return max(total // (4 * buckets), MIN_CONTEXT)


def event_packs(training: DataFrame, bits: np.ndarray, large: np.ndarray, size: int) -> DataFrame:
    """(bucket, contexts, suffixes, counts), packed, of the grams of ``size``
    symbols after candidate contexts that occur more than once: numbers of
    their first and last ``size`` - 1 symbols.  ``bits`` has a bit for every
    candidate, ``large`` in order those of ``large_count``.

    A task packs what it has counted into one row per bucket.  Buckets go by
    context, so that equal contexts lie together and compress; a large context
    is dealt out by gram."""
    buckets = event_buckets(training)
    sent = training.sparkSession.sparkContext.broadcast((bits, large))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, large = sent.value
        contexts, suffixes, held_size = [], [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            # arrays are let go as soon as they are in order
            context = np.concatenate(contexts)
            contexts.clear()
            suffix = np.concatenate(suffixes)
            suffixes.clear()
            dealt = mixed(context)
            if len(large):
                hot = large[np.minimum(np.searchsorted(large, context), len(large) - 1)] == context
                dealt[hot] = joined_id(context[hot], suffix[hot])
            # In order of bucket and context; leading bits of the suffix bring
            # most equal grams together, the rest meet in ``merge``.
            dealt %= np.uint64(buckets)
            dealt <<= np.uint64(48)
            dealt |= context >> np.uint64(40) << np.uint64(24)
            dealt |= suffix >> np.uint64(40)
            order = np.argsort(dealt)
            dealt = dealt[order]
            context = context[order]
            suffix = suffix[order]
            del order
            first = starts(context, suffix)
            n = np.diff(np.append(first, len(context))).astype(np.int32)
            context, suffix = context[first], suffix[first]
            bucket, parts = packs(dealt[first] >> np.uint64(48), {"contexts": context, "suffixes": suffix, "counts": n})
            yield from in_slices(pa.RecordBatch.from_pydict({"bucket": pa.array(bucket.astype(np.int32)), **parts}))
        for batch in batches:
            for symbols, begins in text_symbols(batch.column(1)):
                shorter, ends = grams(symbols, begins, size - 1)
                next_to = np.flatnonzero(ends[1:] == ends[:-1] + 1)
                # grams that end side by side in one text overlap in all but
                # their ends; START stands in the way between texts
                next_to = next_to[symbols[ends[next_to + 1]] != START]
                context, suffix = shorter[next_to], shorter[next_to + 1]
                able = may_hold(bits, context)
                contexts.append(context[able])
                suffixes.append(suffix[able])
                held_size += len(contexts[-1])
                if held_size >= COUNTED:
                    yield from counted()
                    held_size = 0
        if held_size:
            yield from counted()

    def merge(key: tuple, packed: pa.Table) -> pa.Table:
        context, suffix = (unpacked(packed, k, np.uint64) for k in ("contexts", "suffixes"))
        n = unpacked(packed, "counts", np.int32).astype(np.int64)
        context, suffix, n, _ = _summed(context, suffix, n, joined_id(context, suffix))
        often = np.flatnonzero(n > 1)
        often = often[np.argsort(context[often])]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), **one_row(
            contexts=context[often], suffixes=suffix[often], counts=n[often])})

    packed = training.mapInArrow(count, "bucket int, contexts binary, suffixes binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(
        merge, "bucket int, contexts binary, suffixes binary, counts binary")


def count_events(training: DataFrame, candidates: DataFrame, size: int, total: int) -> DataFrame:
    """(context, suffix, n) of ``event_packs`` after candidates (key, c)."""
    large = candidates.filter(F.col("c") > large_count(total, event_buckets(training))).select("key").toArrow()
    events = event_packs(training, key_map(candidates.select("key")), np.sort(large["key"].to_numpy().view(np.uint64)), size)
    return rows_of(events, contexts=np.uint64, suffixes=np.uint64, counts=np.int64).toDF("context", "suffix", "n")


def level_answers(events: DataFrame, level: Parts) -> DataFrame:
    """(bucket, keys, ns, ps, opens), packed: what ``level`` has of the contexts
    and suffixes of each bucket of events.  A bucket asks for each gram once,
    however many of its events hold it."""
    slots = slots_for(events)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, *own in zip(*(batch.column(k).to_pylist() for k in ("bucket", "contexts", "suffixes"))):
                keys = distinct(np.concatenate([np.frombuffer(b, np.uint64) for b in own]))
                at, parts = dealt(keys % np.uint64(slots), {"keys": keys})
                yield pa.RecordBatch.from_pydict({"slot": pa.array(at.astype(np.int32)), "bucket": pa.array(
                    np.full(len(at), bucket, np.int32)), **parts})

    def deal(level: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for arrays in level:
            at, parts = dealt(arrays["keys"] % np.uint64(slots), {k: arrays[k] for k in LEVEL})
            yield from in_slices(pa.RecordBatch.from_pydict({"slot": pa.array(at.astype(np.int32)), **parts}))

    def answer(_: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        arrays = {k: unpacked(held, k, t) for k, t in LEVEL.items()}
        order = np.argsort(arrays["keys"])
        arrays = {k: v[order] for k, v in arrays.items()}
        found, sizes = [np.empty(0, np.int64)], [0]
        for keys in asked.column("keys").to_pylist():
            at = places_of(arrays["keys"], np.frombuffer(keys, np.uint64))
            found.append(at[at >= 0])
            sizes.append(len(found[-1]))
        found, cuts = np.concatenate(found), np.cumsum(sizes)
        return pa.table({"bucket": asked.column("bucket"), **{k: binaries(v[found], cuts) for k, v in arrays.items()}})

    asked = events.select("bucket", "contexts", "suffixes").mapInArrow(ask, "slot int, bucket int, keys binary")
    held = mapped(level, deal, "slot int, " + packed_schema(LEVEL))
    return asked.groupBy("slot").cogroup(held.groupBy("slot")).applyInArrow(answer, "bucket int, " + packed_schema(LEVEL))


def grown(n: np.ndarray, p: np.ndarray, c: np.ndarray, weight: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, gain) of events after their contexts: of c occurrences, with this
    weight of the parent, and the back-off of a state (0: it is none)."""
    smoothed = np.where(back > 0, n / (c + weight) + back * p, p)
    return smoothed, np.where(back > 0, np.log10(smoothed) - np.log10(np.where(back > 0, back, 1.0)) - np.log10(p), 0.0)


def leave_one_out(n: np.ndarray, p: np.ndarray, c: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What events add to the leave-one-out log-likelihood ratio."""
    return n * np.log(((n - 1) / p + weight) / (c - 1 + weight))


def back_off(gain: np.ndarray, c: np.ndarray, once: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Back-offs of contexts that pass the test, 0 of the others; ``gain`` is
    that of the events that occur more than once."""
    passed = gain + once * np.log(weight / (c - 1 + weight)) > MIN_GAIN
    return np.where(passed, (weight + once) / (c + weight), 0.0)


def deepen(training: DataFrame, level: Parts, size: int, total: int, last: bool) -> Parts:
    """The next level, of the contexts in ``level`` (LEVEL): grams of ``size``
    - 1 symbols, how often they occur, the probability of their last symbol
    after the others, and whether a symbol can follow.

    The next level has the events (of the ``last`` level only those of states),
    with their ``gains``: the log of p over what a text without the event would
    get; and the states, packed beside them (state_keys, state_ns, backs).

    A context's events lie in one bucket, which tests it.  Those of a large
    context lie in many; their sums meet by context, and the few results go to
    all tasks."""
    spark = training.sparkSession

    limit = large_count(total, event_buckets(training))

    def candidates(level: Iterator[dict[str, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for arrays in level:
            able = arrays["opens"] & (arrays["ns"] >= least)
            yield arrays["keys"][able], arrays["ns"][able]

    def places(level: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        yield from map_places(keys for keys, _ in candidates(level, MIN_CONTEXT))

    def large_rows(level: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for keys, n in candidates(level, limit + 1):
            yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "c": n})

    found = mapped(level, large_rows, "key long, c long").toArrow()
    large, large_c = found["key"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(large)
    large, large_c = large[order], large_c[order]
    events = shared_table(event_packs(training, united(mapped(level, places, PLACES)), large, size), "lm-events")
    release_shuffles(spark)

    def large_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places_of(large, unpacked(batch, "contexts", np.uint64))
            n = unpacked(batch, "counts", np.int64)[at >= 0]
            at, kinds = np.unique(at[at >= 0], return_inverse=True)
            yield pa.RecordBatch.from_pydict({"at": at, "held": np.bincount(kinds, n, len(at)).astype(np.int64),
                                              "kinds": np.bincount(kinds, minlength=len(at))})

    def by_context(rows: DataFrame, *columns: str) -> list[np.ndarray]:
        """Sums over all buckets, for each large context."""
        sums = rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        out = [np.zeros(len(large), sums[c].to_numpy().dtype) for c in columns]
        for values, c in zip(out, columns):
            values[sums["at"].to_numpy()] = sums[c].to_numpy()
        return out

    held, kinds = by_context(events.select("contexts", "counts").mapInArrow(
        large_counts, "at long, held long, kinds long"), "held", "kinds")
    large_once = large_c - held
    large_weight = large_once + kinds
    sent = spark.sparkContext.broadcast((large, large_once, large_weight))

    def test(_: tuple, events: pa.Table, answers: pa.Table) -> pa.Table:
        large, large_once, large_weight = sent.value
        known = {k: unpacked(answers, k, t) for k, t in LEVEL.items()}
        order = np.argsort(known["keys"])
        known = {k: v[order] for k, v in known.items()}
        context, suffix = (unpacked(events, k, np.uint64) for k in ("contexts", "suffixes"))
        n = unpacked(events, "counts", np.int64)
        of, after = places_of(known["keys"], context), places_of(known["keys"], suffix)
        # the map of candidates lets a few others through
        held = np.flatnonzero((of >= 0) & (after >= 0))
        held = held[known["opens"][of[held]] & (known["ns"][of[held]] >= MIN_CONTEXT)]
        held = held[np.argsort(context[held], kind="stable")]
        context, suffix, n, of, after = (v[held] for v in (context, suffix, n, of, after))
        key, p, open_ = joined_id(context, suffix), known["ps"][after], known["opens"][after]
        first = starts(context)
        sizes = np.diff(np.append(first, len(context)))
        one, c = context[first], known["ns"][of[first]]
        at = places_of(large, one)
        once = c - np.add.reduceat(n, first) if len(first) else c
        once, weight = (np.where(at >= 0, whole[at], own) if len(large) else own
                        for whole, own in ((large_once, once), (large_weight, once + sizes)))
        gain = leave_one_out(n, p, np.repeat(c, sizes), np.repeat(weight, sizes))
        gain = np.add.reduceat(gain, first) if len(first) else gain
        back = np.where(at >= 0, 0.0, back_off(gain, c, once, weight))
        smoothed, gains = grown(n, p, *(np.repeat(v, sizes) for v in (c, weight, back)))
        part = np.repeat(at, sizes)
        own = (part < 0) & (np.repeat(back, sizes) > 0 if last else True)
        is_state, is_part, rest = back > 0, at >= 0, part >= 0
        return pa.table(one_row(
            keys=key[own], ns=n[own], ps=smoothed[own], opens=open_[own], gains=gains[own],
            state_keys=one[is_state], state_ns=c[is_state], backs=back[is_state],
            part_at=at[is_part], part_gains=gain[is_part],
            rest_at=part[rest].astype(np.int32), rest_keys=key[rest], rest_ns=n[rest], rest_ps=p[rest], rest_opens=open_[rest]))

    tested = shared_table(events.groupBy("bucket").cogroup(level_answers(events, level).groupBy("bucket")).applyInArrow(
        test, packed_schema([*DEEPER, "part_at", "part_gains", "rest_at", "rest_keys", "rest_ns", "rest_ps", "rest_opens"])),
        "lm-level")
    drop_shared(events)
    release_shuffles(spark)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"at": unpacked(batch, "part_at", np.int64),
                                              "gain": unpacked(batch, "part_gains", float)})

    gain, = by_context(tested.select("part_at", "part_gains").mapInArrow(parts, "at long, gain double"), "gain")
    back = back_off(gain, large_c, large_once, np.maximum(large_weight, 1))
    back[kinds == 0] = 0.0
    results = spark.sparkContext.broadcast((large_c, large_weight, back))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        large_c, large_weight, back = results.value
        for batch in batches:
            at, keys, n, p, open_ = (unpacked(batch, f"rest_{k}", t) for k, t in (
                ("at", np.int32), ("keys", np.uint64), ("ns", np.int64), ("ps", float), ("opens", bool)))
            if last:
                at, keys, n, p, open_ = (v[back[at] > 0] for v in (at, keys, n, p, open_))
            smoothed, gains = grown(n, p, large_c[at], large_weight[at], back[at])
            rest = {"keys": keys, "ns": n, "ps": smoothed, "opens": open_, "gains": gains}
            yield {k: np.concatenate((unpacked(batch, k, t), rest[k])) if k in rest else unpacked(batch, k, t)
                   for k, t in DEEPER.items()}

    # The states of the large contexts stand beside no event.
    states = {k: np.empty(0, t) for k, t in DEEPER.items()} | {
        "state_keys": large[back > 0], "state_ns": large_c[back > 0], "backs": back[back > 0]}
    return [(tested, finish), (packed_frame(spark, states), arrays_of(DEEPER))]


def packed_frame(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """One packed row of the driver's arrays."""
    return spark.createDataFrame([tuple(bytearray(v.tobytes()) for v in arrays.values())], packed_schema(arrays))


def fit(training: DataFrame, depth: int = DEPTH) -> tuple[Parts, int, float, list[DataFrame]]:
    """(weights, tokens, log, tables): the model as arrays (WEIGHTS), the training tokens, the log10 probability of an unknown word, and
    the shared tables that the weights are read from.  A weight that is
    ``known`` is a symbol's unigram log.  A gram may have several weights, all
    with its count ``n``, which add up."""
    symbols = symbol_packs(training)
    total, kinds, texts = symbols.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (
        F.col("total"), (F.length("keys") / 8).cast("long"), F.col("texts"))]).first()
    width = total + ADD * (kinds + 1)
    unknown = float(np.log10(ADD / width)) if total else 0.0

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for arrays in arrays_of({"keys": np.uint64, "ns": np.int64})(batches):
            yield {**arrays, "ps": (arrays["ns"] + ADD) / width, "opens": arrays["keys"] != END}

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for arrays in root(batches):
            yield {"keys": arrays["keys"], "ns": arrays["ns"], "weights": np.log10(arrays["ps"]),
                   "knowns": np.ones(len(arrays["keys"]), np.int8)}

    def weights_by(read: Reader) -> Reader:
        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
            for arrays in read(batches):
                some = arrays["gains"] != 0
                weights = np.concatenate((np.log10(arrays["backs"]), arrays["gains"][some]))
                yield {**{k: np.concatenate((arrays[f"state_{k}"], arrays[k][some])) for k in ("keys", "ns")},
                       "weights": weights, "knowns": np.zeros(len(weights), np.int8)}
        return weigh

    # Every text has one start and one end.
    start = {"keys": np.array([START]), "ns": np.array([texts]), "ps": np.ones(1), "opens": np.ones(1, bool)}
    level = [(symbols, root), (packed_frame(training.sparkSession, start), arrays_of(LEVEL))]
    weights, tables = [(symbols, unigrams)], [symbols]
    for size in range(2, depth + 2):
        level = deepen(training, level, size, total, size > depth)
        weights += [(frame, weights_by(read)) for frame, read in level]
        tables.append(level[0][0])
    return weights, total, unknown, tables


SCORED = ("row long, doc_id long, n_tokens long, n_known long, base double, weight double, "
          "bucket int, " + ", ".join(f"keys{k} binary, texts{k} binary, times{k} binary" for k in range(ROUNDS)))


def slot_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Round and bucket of a gram, as round * buckets + bucket."""
    return (keys >> np.uint64(40)) % np.uint64(ROUNDS * buckets)


def pack_weights(weights: Parts, least: int, unknown: float, buckets: int) -> DataFrame:
    """(bucket, keys, weights, knowns of each round; hot_keys, hot_weights,
    hot_knowns), packed: the weights of grams that occur less than ``least``
    times, and in rows without a bucket those of the others.  Every word counts
    as unknown at first; rare ones that are known add the rest."""
    names = ("keys", "weights", "knowns")
    rounds = [f"{name}{k}" for name in names for k in range(ROUNDS)]
    columns = ["bucket", *rounds, *[f"hot_{name}" for name in names]]

    def batch_of(n: int, held: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: held.get(k, pa.nulls(n, pa.int32() if k == "bucket" else pa.binary()))
                                           for k in columns})

    def pack(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            key, weight, known = (np.concatenate(c) for c in zip(*held))
            held.clear()
            slots = slot_of(key, buckets)
            order = np.argsort(slots)
            cuts = np.searchsorted(slots[order], np.arange(ROUNDS * buckets + 1, dtype=np.uint64))
            return batch_of(buckets, {"bucket": pa.array(np.arange(buckets, dtype=np.int32)), **by_round(
                {"keys": key[order], "weights": weight[order], "knowns": known[order]}, cuts, buckets)})
        for arrays in parts:
            cold = arrays["ns"] < least
            if not cold.all():
                yield batch_of(1, one_row(**{f"hot_{k}": arrays[k][~cold] for k in names}))
            key, weight, known = (arrays[k][cold] for k in names)
            held.append((key, weight - known * unknown, known))
            size += len(key)
            if size >= ASKED:
                yield packed()
                size = 0
        if size:
            yield packed()

    return mapped(weights, pack, "bucket int, " + packed_schema(columns[1:]))


def by_round(arrays: dict[str, np.ndarray], cuts: np.ndarray, buckets: int) -> dict[str, pa.Array]:
    """Arrays in order of ``slot_of`` as one packed column for each round."""
    return {f"{name}{k}": binaries(values[own[0]:own[-1]], own - own[0]) for name, values in arrays.items()
            for k in range(ROUNDS) for own in (cuts[k * buckets:(k + 1) * buckets + 1],)}


def hot_weights(weights: DataFrame) -> tuple[np.ndarray, ...]:
    """(keys, weights, bases, knowns) of the frequent grams of ``pack_weights``,
    those of one gram summed; ``bases`` is the unigram part."""
    rows = weights.filter("bucket IS NULL").select("hot_keys", "hot_weights", "hot_knowns").toArrow()
    key, weight, known = (unpacked(rows, f"hot_{k}", WEIGHTS[k]) for k in ("keys", "weights", "knowns"))
    order = np.argsort(key)
    first = starts(key[order])
    weight, known = weight[order], known[order]
    sums = [np.add.reduceat(v, first) if len(first) else v for v in (weight, weight * known, known)]
    return key[order[first]], *sums[:2], sums[2].astype(np.int8)


def frequencies(weights: Parts) -> DataFrame:
    """(n, times): counts of grams, and how many weights have them."""
    def count(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for arrays in parts:
            n, times = np.unique(arrays["ns"], return_counts=True)
            yield pa.RecordBatch.from_pydict({"n": n, "times": times})

    return mapped(weights, count, "n long, times long")


def look_up(asked: DataFrame, cold: DataFrame) -> DataFrame:
    """(row, weight, base, known): sums over the grams that the rows ask for in
    one round (bucket, row, keys, texts, times), of its weights (bucket, keys,
    weights, knowns).  Weights of one gram add up; a gram without any adds nothing."""
    def meet(_: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        keys = unpacked(held, "keys", np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        first = starts(keys)
        keys = keys[first]
        weights, knowns = unpacked(held, "weights", float)[order], unpacked(held, "knowns", np.int8)[order].astype(float)
        sums = [np.add.reduceat(v, first) if len(first) else v for v in (weights, weights * knowns, knowns)]
        out = {k: [] for k in ("row", "texts", "weights", "bases", "knowns")}
        for row, ask, texts, times in zip(*(asked.column(k).to_pylist() for k in ("row", "keys", "texts", "times"))):
            ask, texts, times = (np.frombuffer(b, t) for b, t in zip((ask, texts, times), (np.uint64, np.uint16, np.int32)))
            at = np.searchsorted(keys, ask)
            hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == ask) if len(keys) else at[:0]
            if not len(hit):
                continue
            at, texts, times = at[hit], texts[hit], times[hit]
            # texts stand in order
            first = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
            weight, base, known = (np.add.reduceat(v[at] * times, first) for v in sums)
            for k, v in (("row", row), ("texts", texts[first].tobytes()), ("weights", weight.tobytes()),
                         ("bases", base.tobytes()), ("knowns", known.astype(np.int32).tobytes())):
                out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64() if k == "row" else pa.binary()) for k, v in out.items()})

    def total(key: tuple, found: pa.Table) -> pa.Table:
        texts = unpacked(found, "texts", np.uint16)
        weight, base, known = (np.bincount(texts, unpacked(found, k, t)) for k, t in (
            ("weights", float), ("bases", float), ("knowns", np.int32)))
        rows = np.unique(texts)
        return pa.table({"row": key[0].as_py() + rows.astype(np.int64), "weight": weight[rows], "base": base[rows],
                         "known": known[rows].round().astype(np.int64)})

    found = asked.groupBy("bucket").cogroup(cold.groupBy("bucket")).applyInArrow(
        meet, "row long, texts binary, weights binary, bases binary, knowns binary")
    return found.groupBy("row").applyInArrow(total, "row long, weight double, base double, known long")


def score_documents(docs: DataFrame, folds: int = FOLDS, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.

    Training reads the rows whose crc32(doc_id as text) is not divisible by
    ``folds``; a null id reads as the empty text and is held out.  A null or
    empty text is one token, the end.  Rows with equal texts score alike,
    repeated rows are counted and scored each; there are no ties to break.  A
    very long text is read whole, by one task.  Without training rows every
    probability is 1 and every score 0.  An empty table gives no rows; further
    columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights, total, unknown, tables = fit(docs.filter(~held_out(F.col("doc_id"), folds)), depth)
    least = cut_at(frequencies(weights), "n", HOT, "times")
    # A text's sums come back from each bucket that holds one of its grams, so
    # rounds and buckets together are fewer than a long text's grams.
    buckets = min(max(16, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2), 1 << 14)
    packed = shared_table(pack_weights(weights, least, unknown, buckets), "lm-weights")
    for table in tables:
        drop_shared(table)
    keys, *hot = hot_weights(packed)
    cold = packed.filter("bucket IS NOT NULL")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map_places(unpacked(b, k, np.uint64) for b in batches for k in b.schema.names)

    sent = spark.sparkContext.broadcast((
        Lookup(keys), *(np.append(v, 0).astype(v.dtype) for v in hot),
        united(cold.select(*[f"keys{k}" for k in range(ROUNDS)]).mapInArrow(places, PLACES))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, *values, bits = sent.value
        schema = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[kind])
                            for name, kind in (column.split() for column in SCORED.split(", "))])
        held, held_size, first_row, held_rows = [], 0, 0, 0

        def batch_of(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def asked() -> pa.RecordBatch:
            keys, texts = (np.concatenate(c) for c in zip(*held))
            held.clear()
            slots = slot_of(keys, buckets)
            # In order of slot and text, most equal grams side by side.
            order = np.argsort(slots << np.uint64(46) | texts.astype(np.uint64) << np.uint64(30)
                               | keys & np.uint64((1 << 30) - 1))
            keys, texts, slots = keys[order], texts[order], slots[order]
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])))
                                   if len(keys) else np.empty(0, bool))
            times = np.diff(np.append(first, len(keys))).astype(np.int32)
            cuts = np.searchsorted(slots[first], np.arange(ROUNDS * buckets + 1, dtype=np.uint64))
            columns = {"row": pa.array(np.full(buckets, first_row)), "bucket": pa.array(np.arange(buckets, dtype=np.int32)),
                       **by_round({"keys": keys[first], "texts": texts[first], "times": times}, cuts, buckets)}
            return batch_of(buckets, columns)
        for batch in batches:
            done = 0
            for symbols, begins in text_symbols(batch.column(2)):
                if not held:
                    # a task's rows are numbered one after another
                    first_row, held_rows = batch.column(0)[done].as_py(), 0
                sums = np.zeros((3, len(begins)))
                owners = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(symbols))))
                for size in range(1, depth + 2):
                    keys, ends = grams(symbols, begins, size)
                    text = owners[ends]
                    at = lookup.find(keys)
                    for k, value in enumerate(values if size == 1 else values[:1]):
                        sums[k] += np.bincount(text, value[at], len(begins))
                    rare = np.flatnonzero(at < 0)
                    keys, text = keys[rare], text[rare]
                    if size == 1:
                        sums[:2] += unknown * np.bincount(text[keys != START], minlength=len(begins))
                    rare = may_hold(bits, keys)
                    held.append((keys[rare], (text[rare] + held_rows).astype(np.uint16)))
                    held_size += len(held[-1][0])
                n = np.diff(np.append(begins, len(symbols))) - 1
                yield batch_of(len(begins), {
                    "row": batch.column(0).slice(done, len(begins)), "doc_id": batch.column(1).slice(done, len(begins)),
                    "n_tokens": pa.array(n), "n_known": pa.array(sums[2].round().astype(np.int64)),
                    "base": pa.array(sums[1]), "weight": pa.array(sums[0])})
                done += len(begins)
                held_rows += len(begins)
                if held_size >= ASKED or held_rows >= ASKING:
                    yield asked()
                    held_size = 0
        if held:
            yield asked()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = shared_table(rows.mapInArrow(score, SCORED), "lm-scored")
    release_shuffles(spark)
    sums = scored.filter("bucket IS NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "weight")
    for k in range(ROUNDS):
        asked = scored.filter("bucket IS NOT NULL").select(
            "bucket", "row", *[F.col(f"{name}{k}").alias(name) for name in ("keys", "texts", "times")])
        held = cold.select("bucket", *[F.col(f"{name}{k}").alias(name) for name in ("keys", "weights", "knowns")])
        found = shared_table(look_up(asked, held), "lm-found")
        release_shuffles(spark)
        sums = sums.unionByName(found.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias(
            "n_tokens"), F.col("known").alias("n_known"), "base", "weight"))
    drop_shared(packed)
    out = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[
        F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "weight")])
    return out.select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("weight").alias("score"))
