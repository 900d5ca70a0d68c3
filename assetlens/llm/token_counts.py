"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character; dynamic programming carries the best score and its piece count
instead of the path.  Ties follow the unigram tokenizer: a longer last piece
(the earlier start) wins, and only a strictly better score replaces it.  A
character that is no piece itself scores PENALTY below the lowest score and
counts one piece per UTF-8 byte (byte fallback).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, text_batches

MARK = "▁"
PENALTY = 10.0
#: The default vocabulary file: pieces with their scores.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Longer segments are counted without keeping them in the cache.
CACHED_LENGTH = 64


def load_vocabulary(path: str = MODEL_PATH) -> dict[str, float]:
    """Piece -> score; control, unknown and byte pieces match no text."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class PieceCounter:
    """Best score and piece count of texts under a unigram vocabulary."""

    def __init__(self, vocabulary: dict[str, float]):
        self.vocabulary = vocabulary
        self.unknown_score = min(vocabulary.values(), default=0.0) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.cache: dict[str, tuple[float, int, int]] = {}
        # A best path passes every place that no piece spans, so a text may be
        # cut there and the parts added up: before a mark, around a line feed.
        spans_mark = any(MARK in p.lstrip(MARK) for p in vocabulary)
        spans_feed = any("\n" in p for p in vocabulary if len(p) > 1)
        parts = [] if spans_feed else ["\n"]
        other = "" if spans_feed else "\n"
        parts += [f"[^{other}]+"] if spans_mark else [f"{MARK}+[^{MARK}{other}]*", f"[^{MARK}{other}]+"]
        self.segments = re.compile("|".join(parts), re.DOTALL)

    def viterbi(self, text: str) -> tuple[float, int, int]:
        """(best score, pieces, unknown characters) of the best path."""
        size = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        if self.vocabulary:
            for end, piece in self.automaton.iter(text):
                ends[end].append(piece)
        score, pieces, unknown = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        for end in range(size):
            best, single = None, False
            for length, value in sorted(ends[end], reverse=True):
                start = end + 1 - length
                single = single or length == 1
                total = value + score[start]
                if best is None or total > best:
                    best, pieces[end + 1], unknown[end + 1] = total, pieces[start] + 1, unknown[start]
            if not single:
                total = self.unknown_score + score[end]
                if best is None or total > best:
                    best = total
                    pieces[end + 1] = pieces[end] + len(text[end].encode("utf-8"))
                    unknown[end + 1] = unknown[end] + 1
            score[end + 1] = best
        return score[size], pieces[size], unknown[size]

    def count(self, text: str | None) -> tuple[float, int, int]:
        """(score, pieces, unknown characters) of a whole text; spaces become
        marks and a mark is put first.  Null and empty texts have no pieces."""
        if not text:
            return 0.0, 0, 0
        total, pieces, unknown = 0.0, 0, 0
        for segment in self.segments.findall(MARK + text.replace(" ", MARK)):
            known = self.cache.get(segment)
            if known is None:
                known = self.viterbi(segment)
                if len(segment) <= CACHED_LENGTH:
                    if len(self.cache) >= CACHE_ENTRIES:
                        self.cache.clear()
                    self.cache[segment] = known
            total += known[0]
            pieces += known[1]
            unknown += known[2]
        return total, pieces, unknown


def count_tokens(docs: DataFrame, vocabulary: dict[str, float]) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens,
    n_unknown (characters without a piece), n_chars, best_score.

    Each text is read once, in its own task, without a shuffle; a very long
    one is cut at places that no piece spans.  Equal best scores are told
    apart by the tokenizer's own rule.  Null and empty texts count 0, repeated rows are counted alike, an empty table gives
    no rows, and further columns (an n_chars too) are not read.  The
    vocabulary, a fixed file, is all that travels to the tasks.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(vocabulary)
        for ids, texts in text_batches(batches):
            rows = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array([r[1] for r in rows], pa.int64()),
                "n_unknown": pa.array([r[2] for r in rows], pa.int64()),
                "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
                "best_score": pa.array([r[0] for r in rows], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id long, n_tokens long, n_unknown long, n_chars long, best_score double")
