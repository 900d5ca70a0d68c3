"""Line dedup, periodic runs and hard negatives against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetlens.llm import hard_negatives, line_dedup, periodic_runs, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    names = ("hi", "lo", "text_key", "places", "keep", "n_dropped", "n", "kind", "h", "runs", "gid", "score", "ids")
    return df.withColumns({c: F.lit("x") for c in names})


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_periodic_runs", "op13_hard_negatives"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, want.fetchall()))


# --- line dedup -----------------------------------------------------------------

BLANK = " \t\n\v\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def lines_by_hand(rows, min_docs, keep_first=False, min_chars=1):
    """(n_lines, n_dropped, kept text) of each distinct (id, text)."""
    holders = defaultdict(set)
    for doc in rows:
        for line in (doc[1] or "").split("\n"):
            holders[key_of(line)].add(doc)
    shared = {k for k, v in holders.items() if len(v) >= min_docs and len(k) >= min_chars}
    first, out = {}, {}
    for k in shared:
        places = [doc for doc in holders[k]]
        first[k] = min(places, key=lambda d: (d[0] is not None, d[0] or 0))
    for doc in set(rows):
        lines = (doc[1] or "").split("\n")
        gone = [key_of(line) in shared for line in lines]
        if keep_first:
            for k in shared:
                if first[k] == doc:
                    gone[[key_of(line) for line in lines].index(k)] = False
        out[doc] = (len(lines), sum(gone), "\n".join(line for line, g in zip(lines, gone) if not g))
    return out


LINES = ([(i, f"Home\n own {i} \n  HOME\t\n\nhome") for i in range(40)] + [(100, None), (101, ""), (102, "\n"),
         (103, "é Home\nHome \n\x0bhome\x0c"), (104, "same\nrow"), (104, "same\nrow"), (None, "home\nrow\nsame"),
         (None, None), (105, "big " * 50_000 + "\n" + "\n".join(f"l{k}\nhome" for k in range(5000)))]
         + [(200 + i, "\n".join(["row"] * (i % 3)) + "\nsame") for i in range(8)])


@pytest.mark.parametrize("min_docs, keep_first, parts", [(10, False, 4), (10, True, 4), (2, False, 7), (3, True, 13),
                                                         (1, False, 1), (45, False, 9)])
def test_line_dedup_brute_force(spark, min_docs, keep_first, parts):
    """A key in most documents spans several range partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = clashing(docs(spark, LINES))
        got = line_dedup.drop_shared_lines(df, line_dedup.keep_bitmaps(df, min_docs=min_docs, keep_first=keep_first))
        got = sorted(map(str, ((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = lines_by_hand(LINES, min_docs, keep_first)
    assert got == sorted(str((d[0], *want[d])) for d in LINES)


def test_line_dedup_empty_table_and_longer_keys(spark):
    df = docs(spark, LINES)
    empty = df.limit(0)
    assert line_dedup.drop_shared_lines(empty, line_dedup.keep_bitmaps(empty)).count() == 0
    got = line_dedup.drop_shared_lines(df, line_dedup.keep_bitmaps(df, min_chars=4, min_docs=3)).collect()
    want = lines_by_hand(LINES, 3, min_chars=4)
    assert sorted(str((r[0], r[1], r[2], r[3])) for r in got) == sorted(str((d[0], *want[d])) for d in LINES)


def test_line_stream_holds_few_rows():
    """However many documents a hash has, fewer than ``min_docs`` rows wait."""
    state = line_dedup._Stream(3, False)
    for doc in range(1000):
        state.push((1, 2, doc, 0, b"\0\0\0\0"))
        assert len(state.held) <= 3
    state.close(True)
    assert sorted(r[2] for r in state.out if r[6] == "drop") == list(range(1000))
    assert [r[5] for r in state.out if r[6] == "count"] == [1000]


def test_keep_bitmap_round_trip():
    keep = np.array([1, 0, 1, 1, 0, 1, 1, 1], bool)
    bitmap = zlib.compress(np.packbits(keep).tobytes())
    assert line_dedup.kept_lines("a\nb\nc\nd\ne\nf\n\n\nz", bitmap) == (9, b"a\nc\nd\nf\n\n\nz")
    assert line_dedup.kept_lines("", None) == (1, b"")


# --- periodic runs --------------------------------------------------------------

def runs_by_hand(words, min_length=6, min_exponent=4):
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(min_length, min_exponent * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(rng):
    alphabet = rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(alphabet) for _ in range(rng.randrange(120))]
    for _ in range(rng.randrange(4)):
        if len(words) > 10:
            at, period = rng.randrange(len(words)), rng.randrange(1, 20)
            for i in range(at + period, min(len(words), at + rng.randrange(period, 90))):
                words[i] = words[i - period]
    return words


def test_runs_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 5))]
        texts += texts[:1] * rng.randrange(3)
        sizes = [len(t) for t in texts]
        ids = np.array([w for t in texts for w in t], np.int64)
        found = defaultdict(list)
        if len(ids):
            for t, s, e, q in zip(*periodic_runs.runs_of(ids, np.repeat(np.arange(len(texts)), sizes))):
                found[int(t)].append((int(s) - sum(sizes[:t]), int(e - s), int(q)))
        for t, words in enumerate(texts):
            assert found[t] == runs_by_hand(words)


@pytest.mark.parametrize("last_round", [1, 64, 1 << 30])
def test_runs_do_not_depend_on_the_grammar(monkeypatch, last_round):
    """A grammar cut early leaves more gaps, never fewer runs."""
    monkeypatch.setattr(periodic_runs, "LAST_ROUND", last_round)
    rng = random.Random(6)
    for _ in range(60):
        words = random_words(rng) + random_words(rng)
        got = periodic_runs.runs_of(np.array(words, np.int64), np.zeros(len(words), np.int64)) if words else [[]] * 4
        assert [(int(s), int(e - s), int(q)) for _, s, e, q in zip(*got)] == runs_by_hand(words)


def test_grammar_derives_its_text():
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 4, 500), np.tile(rng.integers(0, 9, 30), 40), np.zeros(99, int)])
    text = np.repeat([0, 1, 2], [500, 1200, 99])
    g = periodic_runs.Grammar(words, text)

    def derive(symbol):
        if symbol < g.terminals:
            return [symbol]
        return derive(g.left[symbol - g.terminals]) + derive(g.right[symbol - g.terminals])

    assert [w for s in g.symbols.tolist() for w in derive(s)] == words.tolist()
    for rule in range(len(g.left)):
        own = derive(g.terminals + rule)
        assert len(own) == g.length[rule] and words[g.place[rule]:g.place[rule] + len(own)].tolist() == own
    assert len(g.symbols) < 400


RUN_DOCS = [(1, "a b c " * 8 + "tail"), (2, None), (3, ""), (4, "x\ty\x0bz"), (5, "la " * 7), (5, "la " * 7),
            (None, "a a a a a a b b b b b b"), (6, "w" * 300_000 + " " + "p q " * 9), (7, "A a A a A a A a a"),
            (8, " ".join(str(i) for i in range(40_000))), (9, " ".join(str(i % 5000) for i in range(21_000))),
            (10, "é é é é é é é é é é é é")]


def test_find_runs_edge_rows(spark):
    rows = periodic_runs.find_runs(clashing(docs(spark, RUN_DOCS))).collect()
    assert len(rows) == len(RUN_DOCS)
    want = []
    for i, text in RUN_DOCS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = runs_by_hand(words) if len(words) < 1000 else [(0, 21_000, 5000)] * (i == 9)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append(str((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone))))
    got = [str((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in rows]
    assert sorted(got) == sorted(want)
    assert periodic_runs.find_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs(spark, []), min_exponent=3)


def test_run_digests(spark):
    found = periodic_runs.find_runs(docs(spark, [(1, "x x x x x x y z y z y z y z y z y z q"), (2, "none")]))
    one, two = periodic_runs.run_digests(found).orderBy("doc_id").collect()
    assert (one["n_runs"], one["start"], one["length"], one["period"], one["exponent_milli"]) == (2, 0, 6, 1, 6000)
    assert one["runs_sha256"] == hashlib.sha256(b"0,6,1\n6,12,2\n").hexdigest()
    assert one["collapsed_sha256"] == hashlib.sha256(b"x y z q").hexdigest()
    assert (two["n_runs"], two["start"], two["runs_sha256"]) == (0, None, hashlib.sha256(b"").hexdigest())


def test_texts_are_grouped(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 5)
    groups = list(periodic_runs._groups(["a b c", None, "d e", "f " * 20, "", "g"]))
    assert [[len(w) for w in g] for g in groups] == [[3, 0, 2], [20], [0, 1]]


# --- hard negatives -------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def negatives_by_hand(rows, positives=5, negatives=10):
    own = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            own[i] = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for a, (la, va) in own.items():
        if a % 100:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in own.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == la][:positives]:
            fits = [r for r in ranked if r[2] != la and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def vector_rows(seed, n, width=8, hot=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    same = (centres[0] / 4).astype(float).tolist()
    rows = []
    for i in range(n):
        v = ((centres[rng.integers(6)] + 0.5 * rng.normal(size=width)) / 4).astype(float).tolist()
        rows.append((i, same if rng.random() < hot else v, int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("seed, n, hot", [(1, 900, 0.0), (2, 900, 0.4), (3, 150, 0.9)])
def test_mine_brute_force(spark, monkeypatch, seed, n, hot):
    monkeypatch.setattr(hard_negatives, "QUERY_BLOCK", 3)
    rows = vector_rows(seed, n, hot=hot)
    got = hard_negatives.mine(clashing(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)


def test_mine_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vector_rows(4, 120, 4) + [
        (200, None, 1), (201, [0.1, None, 0.2, 0.3], 1), (202, [nan, 0.0, 0.0, 0.0], 0), (203, [inf, 0.0, 0.0, 0.0], 0),
        (300, [0.1, 0.2, 0.3, 0.4], None), (None, [0.1, 0.2, 0.3, 0.4], 1), (400, [0.0] * 4, 1), (401, [], 2),
        (500, [0.5, 0.25], 2), (501, [0.5, 0.25, 0.0, 0.0], 0), (600, [3000.0, -3000.0, 1.0, 1.0], 0)]
    want = negatives_by_hand(rows)
    df = spark.createDataFrame(rows + rows[:7], VECTORS)
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == want
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_cells_come_by_bound_and_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.integers(-60, 60, (400, 6))
    books = hard_negatives.Codebooks(6, 3, hard_negatives._k_means(x[:, :3], 5, 3),
                                     hard_negatives._k_means(x[:, 3:], 5, 3))
    first, second = books.codes(x)
    block = hard_negatives.CellBlock(pa.table({
        "code1": pa.array(first, pa.int32()), "code2": pa.array(second, pa.int32()),
        "vector": pa.array(x.tolist(), pa.list_(pa.int64())), "label": pa.array([0] * 400),
        "ids": pa.array([[i] for i in range(400)], pa.list_(pa.int64()))}), books)
    for _ in range(20):
        q = rng.integers(-60, 60, 6)
        cells = list(block.by_bound(q.astype(float)))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
        assert sum(e - s for _, _, s, e in cells) == 400
        for upper, lower, s, e in cells:
            scores = block.x[s:e] @ q
            assert lower <= scores.min() and scores.max() <= upper


def test_search_stops_early():
    """Well separated clusters: most rows are never scored."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-200, 200, (16, 8))
    x = centres[rng.integers(16, size=4000)] + rng.integers(-3, 4, (4000, 8))
    books = hard_negatives.Codebooks(8, 4, hard_negatives._k_means(x[:, :4], 16, 10),
                                     hard_negatives._k_means(x[:, 4:], 16, 10))
    first, second = books.codes(x)
    block = hard_negatives.CellBlock(pa.table({
        "code1": pa.array(first, pa.int32()), "code2": pa.array(second, pa.int32()),
        "vector": pa.array(x.tolist(), pa.list_(pa.int64())), "label": pa.array([0] * 4000),
        "ids": pa.array([[i] for i in range(4000)], pa.list_(pa.int64()))}), books)
    scored = []
    plain = block.scores
    block.scores = lambda spans, *a: scored.append(sum(e - s for s, e in spans)) or plain(spans, *a)
    best = hard_negatives.Best(10)
    hard_negatives.search(block, x[0], 0, True, [best])
    ranked = sorted(zip((-(x @ x[0])).tolist(), range(4000)))[:10]
    assert best.rows == ranked and sum(scored) < 2000


def test_window_bounds():
    for p in range(-50, 200):
        low, high = hard_negatives.window(p)
        for s in range(-60, 210):
            assert (low <= s <= high) == (30 * p <= 100 * s <= 90 * p)
