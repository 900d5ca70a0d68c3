"""Periodic runs of words, found in a grammar.

The word ids of a group of texts are compressed with Re-Pair: each round
replaces, all over the group, the pairs that are more frequent than the pairs
they overlap, by one nonterminal per pair.  Every gap between two
neighbouring words belongs to one node of the derivation.  A run lies whole
inside the lowest node that covers it and crosses that node's gap, so runs are
only looked for across the gap of each nonterminal, once, at one place where
it stands, and across the gaps of the symbols that remain.  Found intervals
are translated upwards, round by round, to every place a nonterminal derives,
and merged where they prolong each other.

Runs across a gap.  Let a run have period q, length >= 4 q, and let m be the
power of two with q <= m < 2 q.  Then one of the m-grams that begin or end at
the gap has its nearest equal, before or after it, at distance q, inside the
run.  Names of m-grams come by doubling (pairs of names of m/2-grams) and are
kept only where the gram occurs again in its document, so they die out fast;
the same names give exact longest common extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run and least exponent (length / period).
MIN_LENGTH = 6
MIN_EXPONENT = 4

#: Words of texts that share a grammar; a longer text has one of its own.
GROUP_WORDS = 1 << 18

#: A round that replaces fewer than this share of the symbols is the last.
LAST_ROUND = 64

#: m-grams up to this length are compared shift by shift.
SHIFTED = 8

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Grammar:
    """Re-Pair grammar of several texts: rules in order of their rounds, and
    the symbols that remain with the text positions they begin at."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.terminals = int(words.max(initial=-1)) + 1
        self.symbols, self.text = words.astype(np.int64), text
        self.starts = np.arange(len(words))
        self.left = self.right = self.length = self.place = np.empty(0, np.int64)
        self.rounds: list[tuple[int, int]] = []  # rules made by each round
        self.codes = self.code_rules = np.empty(0, np.int64)  # pairs with a rule, sorted
        while self._round():
            pass

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        rules = symbols - self.terminals
        out = np.ones(len(symbols), np.int64)
        out[rules >= 0] = self.length[rules[rules >= 0]]
        return out

    def _round(self) -> bool:
        """Replace the pairs that beat their neighbours; whether to go on."""
        s = self.symbols
        at = np.flatnonzero(self.text[1:] == self.text[:-1])
        if not len(at):
            return False
        own, pairs = pd.factorize((s[at] << 32) | s[at + 1])
        counts = np.bincount(own)
        slot = np.minimum(np.searchsorted(self.codes, pairs), max(len(self.codes) - 1, 0))
        known = self.codes[slot] == pairs if len(self.codes) else np.zeros(len(pairs), bool)
        rank = np.where((counts > 1) | known, counts * len(pairs) + np.arange(len(pairs)), -1)
        weight = np.full(len(s) + 1, -1, np.int64)  # of the pair that begins at symbol i - 1
        weight[at + 1] = rank[own]
        # stretches of one pair (a a a ...) are replaced from the left
        begin = np.flatnonzero(np.r_[True, weight[1:] != weight[:-1]])
        value = weight[begin]
        peak = np.r_[False, value[1:] > value[:-1]] & np.r_[value[:-1] > value[1:], True] & (value >= 0)
        sizes = np.diff(np.r_[begin, len(weight)])[peak]
        offsets = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        taken = (np.repeat(begin[peak], sizes) + offsets)[offsets % 2 == 0] - 1
        if not len(taken):
            return False
        used = own[np.searchsorted(at, taken)]
        rules = np.full(len(pairs), -1, np.int64)
        rules[known] = self.code_rules[slot[known]]
        fresh, first = np.unique(used[rules[used] < 0], return_index=True)
        rules[fresh] = len(self.left) + np.arange(len(fresh))
        where = taken[rules[used] < len(self.left)], taken[rules[used] >= len(self.left)]
        left, right = pairs[fresh] >> 32, pairs[fresh] & 0xFFFFFFFF
        lengths = self.lengths(left) + self.lengths(right)
        self.rounds.append((len(self.left), len(self.left) + len(fresh)))
        self.left, self.right = np.concatenate((self.left, left)), np.concatenate((self.right, right))
        self.length = np.concatenate((self.length, lengths))
        self.place = np.concatenate((self.place, self.starts[where[1][first]]))
        self.codes = np.concatenate((self.codes, pairs[fresh]))
        self.code_rules = np.concatenate((self.code_rules, rules[fresh]))
        order = np.argsort(self.codes)
        self.codes, self.code_rules = self.codes[order], self.code_rules[order]
        s[taken] = self.terminals + rules[used]
        stay = np.ones(len(s), bool)
        stay[taken + 1] = False
        self.symbols, self.starts, self.text = s[stay], self.starts[stay], self.text[stay]
        return len(taken) * LAST_ROUND >= len(s)


class Repeats:
    """Names of the 2**j-grams that occur again in their own text (-1 where
    they do not); the last entry of each level stands for 'outside'."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.size = len(words)
        self.levels: list[np.ndarray] = []
        at, codes = np.arange(len(words)), (text.astype(np.int64) << 32) | words
        while len(at):
            names, distinct = pd.factorize(codes)
            again = np.bincount(names, minlength=len(distinct))[names] > 1
            level = np.full(len(words) + 1, -1, np.int32)
            level[at[again]] = names[again]
            if not again.any():
                break
            step = 1 << len(self.levels)
            self.levels.append(level)
            at = at[again]
            at = at[at + step < len(words)]
            at = at[level[at + step] >= 0]
            codes = (level[at].astype(np.int64) << 32) | level[at + step]

    def near(self, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, distances) of 2**j-grams whose next equal stands more than
        2**(j - 1) and at most 2**j words on."""
        level, m = self.levels[j], 1 << j
        if m <= SHIFTED:
            for q in range(m // 2 + 1, m + 1):
                if q < self.size:
                    at = np.flatnonzero((level[:-1 - q] == level[q:-1]) & (level[:-1 - q] >= 0))
                    yield at, np.full(len(at), q)
            return
        at = np.flatnonzero(level >= 0)
        names = level[at]
        order = np.argsort(names, kind="stable")
        at, names = at[order], names[order]
        gaps = at[1:] - at[:-1]
        close = (names[1:] == names[:-1]) & (gaps <= m) & (gaps > m // 2)
        yield at[:-1][close], gaps[close]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from a on that equal those from b on, a < b."""
        done = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            x, y = (np.minimum(p + done, self.size) for p in (a, b))
            level = self.levels[j]
            done += ((level[x] == level[y]) & (level[x] >= 0)).astype(np.int64) << j
        return done

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before a that equal those before b, a < b."""
        done = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            x, y = (p - done - (1 << j) for p in (a, b))
            level = self.levels[j]
            x = np.where(x < 0, self.size, x)
            y = np.where(y < 0, self.size, y)
            done += ((level[x] == level[y]) & (level[x] >= 0)).astype(np.int64) << j
        return done


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals in order of (owner, period, start), those of one owner and
    period that share at least a period's words joined."""
    if not len(owner):
        return owner, start, end, period
    order = np.lexsort((start, period, owner))
    owner, start, end, period = (a[order] for a in (owner, start, end, period))
    group = np.cumsum(np.r_[False, (owner[1:] != owner[:-1]) | (period[1:] != period[:-1])])
    base = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base) - base
    new = np.r_[True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - period[1:])]
    first = np.flatnonzero(new)
    return owner[first], start[first], np.maximum.reduceat(end, first), period[first]


def _primitive(owner: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of intervals of one owner with the same ends, the one of the smallest
    period: the others repeat a repetition."""
    order = np.lexsort((period, end, start, owner))
    owner, start, end, period = (a[order] for a in (owner, start, end, period))
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
                           if len(owner) else np.empty(0, bool))
    return owner[first], start[first], end[first], period[first]


def _inherited(pieces: tuple[np.ndarray, ...], rules: np.ndarray, owners: np.ndarray,
               shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces of ``rules`` (sorted by rule in ``pieces``), moved by
    ``shift`` and given to ``owners``."""
    low, high = (np.searchsorted(pieces[0], rules, side) for side in ("left", "right"))
    counts = high - low
    some = np.flatnonzero(counts)
    counts = counts[some]
    index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[some], counts)
    moved = np.repeat(shift[some], counts)
    return np.repeat(owners[some], counts), pieces[1][index] + moved, pieces[2][index] + moved, pieces[3][index]


def crossing(repeats: Repeats, node: np.ndarray, low: np.ndarray, high: np.ndarray, min_length: int,
             min_exponent: int) -> tuple[np.ndarray, ...]:
    """(gap, start, end, period) of the runs that cross a gap b inside its
    node, the words low[b] to high[b]; ``node[b]`` is negative where the gap
    is that of another occurrence."""
    found = []
    for j in range(len(repeats.levels)):
        m = 1 << j
        for at, q in repeats.near(j):
            for gap in (at, at + q, at + m, at + m + q):
                use = np.flatnonzero((gap > 0) & (gap < repeats.size))
                use = use[node[gap[use]] >= 0]
                b, a = gap[use], at[use]
                inside = (a >= low[b]) & (a + q[use] < high[b])
                found.append((b[inside], a[inside], q[use][inside]))
    if not found:
        return (np.empty(0, np.int64),) * 4
    b, a, q = (np.concatenate(c) for c in zip(*found))
    start = a - np.minimum(repeats.backward(a, a + q), a - low[b])
    end = a + q + np.minimum(repeats.forward(a, a + q), high[b] - a - q)
    fits = (start < b) & (end > b) & (end - start >= np.maximum(min_length, min_exponent * q))
    return _primitive(b[fits], start[fits], end[fits], q[fits])


def runs_of(words: np.ndarray, text: np.ndarray, min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, end, period) of all runs, in order of text, start and
    period; ``text`` holds the number of each word's text, ascending, and
    places count from the group's first word."""
    grammar, repeats = Grammar(words, text), Repeats(words, text)
    node = np.full(len(words) + 1, -1, np.int64)
    low, high = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
    rules = np.arange(len(grammar.left))
    gap = grammar.place + grammar.lengths(grammar.left)
    node[gap], low[gap], high[gap] = rules, grammar.place, grammar.place + grammar.length
    bounds = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True])
    inner = np.flatnonzero(np.r_[False, grammar.text[1:] == grammar.text[:-1]])
    gap, own = grammar.starts[inner], np.searchsorted(bounds, grammar.starts[inner], "right") - 1
    node[gap], low[gap], high[gap] = len(rules) + own, bounds[own], bounds[own + 1]

    b, start, end, period = crossing(repeats, node, low, high, min_length, min_exponent)
    owner = node[b]
    whole = owner >= len(rules)
    across = owner[~whole], (start - low[b])[~whole], (end - low[b])[~whole], period[~whole]
    pieces = (np.empty(0, np.int64),) * 4
    for first, last in grammar.rounds:
        own = rules[first:last]
        children = (grammar.left[first:last], grammar.right[first:last])
        mine = (across[0] >= first) & (across[0] < last)
        parts = [tuple(a[mine] for a in across)]
        for child, shift in zip(children, (np.zeros(len(own), np.int64), grammar.lengths(children[0]))):
            parts.append(_inherited(pieces, child - grammar.terminals, own, shift))
        made = _merged(*(np.concatenate(c) for c in zip(*parts)))
        pieces = tuple(np.concatenate(c) for c in zip(pieces, made))
    top = _inherited(pieces, grammar.symbols - grammar.terminals, grammar.text, grammar.starts)
    found = (np.concatenate((top[0], text[b[whole]])), np.concatenate((top[1], start[whole])),
             np.concatenate((top[2], end[whole])), np.concatenate((top[3], period[whole])))
    owner, start, end, period = _primitive(*_merged(*found))
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], end[order], period[order]


def _groups(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Word lists of the texts, about GROUP_WORDS words together."""
    group, size = [], 0
    for text in texts:
        words = text.encode("utf-8").split() if text else []
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _rows(group: list[list[bytes]], min_length: int, min_exponent: int) -> Iterator[tuple[int, list[tuple], bytes]]:
    """(words, runs, collapsed text) of each text of a group."""
    sizes = np.array([len(w) for w in group])
    ends = np.cumsum(sizes)
    flat = [w for words in group for w in words]
    ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(group)), sizes)
    owner, start, end, period = runs_of(ids, text, min_length, min_exponent) if len(flat) else ([],) * 4
    found: dict[int, list[tuple[int, int, int]]] = {}
    for t, s, e, q in zip(*(np.asarray(a).tolist() for a in (owner, start, end, period))):
        found.setdefault(t, []).append((s, e, q))
    for t, words in enumerate(group):
        base = int(ends[t] - sizes[t])
        runs = [(s - base, e - s, q) for s, e, q in found.get(t, ())]
        if runs:
            change = np.zeros(len(words) + 1, np.int64)
            for s, n, q in runs:
                change[s + q] += 1
                change[s + n] -= 1
            kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        else:
            kept = words
        yield len(words), runs, b" ".join(kept)


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs
    (start, length, period, by start and period), collapsed.

    A run is a stretch of words with smallest period q, of at least
    ``min_length`` words and ``min_exponent`` (4 or more) periods, that no
    neighbouring word prolongs.  ``collapsed`` holds the words, joined by one
    space, without those that a run contains after its first period.

    Texts are read once, each in its own task, without a shuffle.  Null and
    empty texts have no words and no runs; a very long text is a group of its
    own, held by one task.  Runs may overlap, and equal starts are told apart
    by period.  Repeated rows give equal rows, an empty table none, and
    further columns are not read.
    """
    if min_exponent < 4:
        raise ValueError("runs of fewer than four periods are not found")
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1).to_pylist()):
                counts, runs, texts = zip(*_rows(group, min_length, min_exponent))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), pa.array(counts, pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in row] for row in runs],
                              pa.list_(struct)),
                     pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
                at += len(group)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS)


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent and digests of runs and text."""
    better = ("CASE WHEN b.period IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END")
    best = F.expr(f"""aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>),
                                (b, r) -> {better})""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
