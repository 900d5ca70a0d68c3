"""License scan, toxicity, language model, Jaccard join, decontamination and
token counts against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlens.llm import (common, decontamination, jaccard_join, license_scan, queries, suffix_tree_lm, token_counts,
                           toxicity)
from assetlens.llm.common import table, words_of
from assetlens.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    names = ("n", "word", "words", "gid", "node", "shingle", "score", "labels", "text_key", "rare", "source", "prefix")
    return df.withColumns({c: F.lit("x") for c in names})


# --- license scan ---------------------------------------------------------------

APACHE = "Licensed under the Apache License, Version 2.0"
LICENSES = [(1, "x CC-BY 4.0. cc by by CC By"), (2, None), (3, ""), (4, f"a\n{APACHE}\nb"),
            (5, "word " * 500 + APACHE.upper() + " tail" * 200), (6, "All rights\nreserved. all Rights RESERVED"),
            (7, "the License Version 2.0 licensed by"), (8, "general public licenseé general\0public-license"),
            (9, "Permission is hereby granted free of charge to any person"), (4, f"a\n{APACHE}\nb"), (None, "gpl")]


def licenses_by_hand(text):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    words, places, labels, best = split(text), [], set(), 0.0
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    # the whole text first: its windows hold most of those of its lines
    for row in [words, *map(split, (text or "").split("\n"))]:
        for at in range(0, max(len(row) - license_scan.BLOCK, 0) + license_scan.STEP, license_scan.STEP):
            block = set(row[at:at + license_scan.BLOCK])
            for label, template in license_scan.TEMPLATES:
                own = set(split(template))
                if 100 * len(own & block) >= license_scan.THRESHOLD * len(own):
                    labels.add(label)
                    best = max(best, len(own & block) / len(own))
    base = sorted({label for _, label in places})
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
            ",".join(sorted(labels | set(base))), 1.0 if places else best)


def test_license_scan_brute_force(spark):
    df = clashing(docs(spark, LICENSES))
    rows = license_scan.license_summary(license_scan.scan_licenses(df)).collect()
    assert len(rows) == len(LICENSES)
    by_id = {r["doc_id"]: r for r in rows}
    for i, text in LICENSES:
        assert tuple(by_id[i])[1:] == licenses_by_hand(text), (i, by_id[i])
    assert by_id[5]["labels"] == "apache" and by_id[1]["n_base"] == 3
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_filters_lose_no_pair(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for _, ws in license_scan.template_words(license_scan.TEMPLATES) for w in ws})
    frequencies = {w: rng.randrange(1000) for w in vocabulary}
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, frequencies, 60)
    for _ in range(400):
        block = rng.sample(vocabulary, rng.randrange(1, len(vocabulary))) + [b"other"]
        want = {(t, len(words & set(block))) for t, (_, words, need) in enumerate(index.templates)
                if len(words & set(block)) >= need}
        assert set(index.links(block)) == want


WRAPPED = [
    ("bsd", "x = 1\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted "
            "provided that the following conditions\n# are met:\n#\n"),
    ("mpl", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. */\n"),
]


def test_license_templates_that_wrap(spark):
    rows = [(k, "code here\n" * (17 * k) + text + "more code\n" * 90) for k in range(4) for _, text in WRAPPED]
    wanted = [label for _ in range(4) for label, _ in WRAPPED]
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    got = license_scan.license_summary(license_scan.scan_licenses(docs(spark, rows))).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in got] == [(label, 1.0) for label in wanted]
    match = license_scan.scan_licenses(docs(spark, rows[:1])).first()["matches"][0]
    assert (match["label"], match["line"], match["word"]) == ("bsd", 0, 0)


def test_license_sql_cuts_blocks_as_the_operator_does(spark):
    """Wrapped templates, long lines and edge rows, by the query's SQL."""
    rng = random.Random(9)
    rows = [(i, "\n".join(" ".join(["pad"] * rng.choice([0, 3, 31, 33, 70])) + " " + rng.choice(
        [text, text.replace("\n", " "), APACHE, "cc by", ""]) for _ in range(rng.randrange(4))))
        for i, (_, text) in enumerate(WRAPPED * 20)] + [(100, None), (101, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(queries.ORACLE_SQL["op1_license_scan"]).fetchall()
    got = license_scan.license_summary(license_scan.scan_licenses(docs(spark, rows)))
    names = [d[0] for d in con.description]
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, want))
    labels = {r[names.index("labels")] for r in want}
    assert {"bsd", "mpl"} <= {x for row in labels for x in row.split(",")}
    for i, text in rows:
        own = next(r for r in want if r[0] == i)
        assert tuple(own[names.index(c)] for c in ("n_words", "labels", "score")) == (
            (lambda h: (h[0], h[5], h[6]))(licenses_by_hand(text))), i


def test_license_blocks_hold_those_of_the_lines():
    rng = random.Random(4)
    for _ in range(300):
        lines = [[b"%d" % rng.randrange(50) for _ in range(rng.choice([0, 3, 30, 33, 64, 65, 150]))]
                 for _ in range(rng.randrange(6))]
        blocks = list(license_scan.blocks_of(b"\n".join(b" ".join(row) for row in lines)))
        words = [w for row in lines for w in row]
        assert all(words[at:at + len(own)] == own and len(own) <= license_scan.BLOCK for _, at, own in blocks)
        spans = [(at, at + len(own)) for _, at, own in blocks]
        runs = [(i, min(i + license_scan.STEP, len(words))) for i in range(len(words))]
        start = 0
        for row in lines:
            steps = range(0, max(len(row) - license_scan.BLOCK, 0) + license_scan.STEP, license_scan.STEP)
            runs += [(start + at, start + min(at + license_scan.BLOCK, len(row))) for at in steps if row]
            start += len(row)
        assert all(any(a <= x and y <= b for a, b in spans) for x, y in runs)


def test_license_query_on_the_documents(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.license_summary(
        license_scan.scan_licenses(table(spark, SF, "documents"))).collect()}
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        assert got[r["doc_id"]] == licenses_by_hand(r["text"])


# --- toxicity -------------------------------------------------------------------

def toxic_corpus(spark, n=900):
    rng = random.Random(1)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    bad = ["zorkwut", "plimqux"]
    ends = ["ing", "er", "s", "ly", "ish", "ed", "o", "an"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 200))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(ends))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out_accuracy_and_misspellings(spark):
    df, labels = toxic_corpus(spark)
    model = toxicity.fit(df, labels)
    rows = toxicity.score_toxicity(df, *model).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    # Endings and spellings that no training text holds.
    unseen = docs(spark, [(1, "abc def zorkwutten hij"), (2, "a plimquxx"), (3, "abc def hij"), (4, "abc " * 3000 + "zorkwuts")])
    assert [r["predicted"] for r in toxicity.score_toxicity(unseen, *model).orderBy("doc_id").collect()] == [1, 1, 0, 1]


def test_toxicity_edge_rows(spark):
    df, labels = toxic_corpus(spark, 200)
    model = toxicity.fit(df, labels.unionAll(spark.createDataFrame([(1, None), (None, 1), (0, 1)], labels.schema)))
    rows = [(1, None), (2, ""), (3, " ... "), (4, "é" * 100_000), (5, "zorkwut " * 30_000), (5, "zorkwut " * 30_000),
            (None, "abc")]
    got = toxicity.score_toxicity(clashing(docs(spark, rows)), *model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] == 5}.__len__() == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    kept = toxicity.drop_toxic(clashing(docs(spark, rows)), *model)
    assert kept.columns == clashing(docs(spark, rows)).columns and 5 not in {r["doc_id"] for r in kept.collect()}
    assert toxicity.score_toxicity(df.limit(0), *model).count() == 0
    none = toxicity.fit(df, labels.limit(0))
    assert toxicity.score_toxicity(df, *none).filter("predicted = 1").count() == 0


def test_subwords_stay_inside_words():
    buckets, starts = toxicity.subwords(["abcd", "x", "", "abcd"])
    parts = [sorted(p) for p in np.split(buckets, starts[1:])]
    assert parts[0] == parts[3] and len(parts[0]) == 4 + 3 + 2 + 1
    assert len(parts[1]) == 2 and len(parts[2]) == 1


# --- language model ---------------------------------------------------------------

def base_by_hand(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            counts.update(re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""])
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""]
        score = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) if total else 0.0 for w in tokens)
        out[i] = (len(tokens), sum(counts[w] > 0 for w in tokens), total, score)
    return out


def test_language_model_base_and_gain(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in suffix_tree_lm.score_documents(docs(spark, rows)).collect()}
    want = base_by_hand(rows)
    for i, (n, known, total, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], score, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    # Contexts carry over to unseen documents: more likely than word by word.
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.8 * len(held)


def tree_by_hand(rows, depth=2):
    """Scores from a plain suffix tree over nested dictionaries."""
    train, out = [], []
    for i, t in rows:
        tokens = ["<"] + re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""]
        out.append((i, tokens))
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            train.append(tokens)
    unigrams = Counter(w for t in train for w in t[1:])
    total, kinds = sum(unigrams.values()), len(unigrams)
    nexts = {}
    for tokens in train:
        for k in range(1, len(tokens)):
            for d in range(1, depth + 1):
                if k - d >= 0:
                    nexts.setdefault(tuple(tokens[k - d:k]), Counter())[tokens[k]] += 1

    def p(context, word):
        if not context:
            return (unigrams[word] + 0.1) / (total + 0.1 * (kinds + 1)) if total else 1.0
        parent = p(context[1:], word)
        if context not in states:
            return parent
        c, weight, once = states[context]
        n = nexts[context][word]
        return (n / (c + weight) if n > 1 else 0.0) + (weight + once) / (c + weight) * parent
    states = {}
    for d in range(1, depth + 1):
        for context, counts in nexts.items():
            c, weight, once = sum(counts.values()), len(counts), sum(n == 1 for n in counts.values())
            if len(context) == d and c >= suffix_tree_lm.MIN_CONTEXT and once < weight:
                gain = sum(n * math.log(((n - 1) / p(context[1:], w) + weight) / (c - 1 + weight))
                           for w, n in counts.items())
                if gain > suffix_tree_lm.MIN_GAIN:
                    states[context] = (c, weight, once)
    scores = [(i, sum(math.log10(p(tuple(t[max(k - depth, 0):k]), t[k])) for k in range(1, len(t)))) for i, t in out]
    return scores, states, p, unigrams


def phrases(seed, n=200):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["a b c", "d e f", "a b d g", f"r{rng.randrange(60)} s t", rng.choice("abcdefg")])
                         for _ in range(rng.randrange(40)))) for i in range(n)]


@pytest.mark.parametrize("depth, hot, counted", [(1, 2_000_000, 1 << 22), (2, 2_000_000, 1 << 22), (2, 20, 500),
                                                 (3, 0, 1000)])
def test_language_model_equals_a_plain_suffix_tree(spark, monkeypatch, depth, hot, counted):
    rows = phrases(8) + [(7, "A  b c"), (8, "a b c"), (10, None), (30, "unseen words")]
    monkeypatch.setattr(suffix_tree_lm, "HOT", hot)
    monkeypatch.setattr(suffix_tree_lm, "COUNTED", counted)
    got = suffix_tree_lm.score_documents(docs(spark, rows), depth=depth).collect()
    want, states, _, _ = tree_by_hand(rows, depth)
    assert any(len(c) == depth for c in states)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in got) == sorted(
        (i is None, i or 0, round(s, 6)) for i, s in want)
    assert any(r["score"] > r["base_score"] + 5 for r in got)


def test_language_model_looks_up_in_packed_rounds(spark, monkeypatch):
    """The grams that texts ask for are never rows of one join: the plan that
    is returned only adds up the rounds' sums."""
    monkeypatch.setattr(suffix_tree_lm, "HOT", 20)
    monkeypatch.setattr(suffix_tree_lm, "ASKED", 300)
    rows = phrases(5, 60)
    scored = suffix_tree_lm.score_documents(docs(spark, rows))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in scored.collect()) == sorted(
        (i, round(x, 6)) for i, x in tree_by_hand(rows)[0])


def test_language_model_keeps_grams_packed(spark):
    """The tables of grams have a row per bucket, not one per gram."""
    weights, total, _, tables = suffix_tree_lm.fit(docs(spark, phrases(5, 60)))
    rows = [t.count() for t in tables]
    held = suffix_tree_lm.frequencies(weights).selectExpr("sum(times)").first()[0]
    assert len(rows) == 3 and max(rows) <= 64 and total > 500 and held > sum(rows)


def test_questions_of_buckets_are_few(spark):
    """At most one row for each bucket of events and slot of the level before."""
    df, partitions = docs(spark, phrases(5, 10)), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        assert suffix_tree_lm.event_buckets(df) * suffix_tree_lm.slots_for(df) < 50_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_key_map_has_a_bit_for_every_key_and_no_other(spark):
    keys = [0, 1, 5, 31, 32, (1 << 27) - 1, 1 << 27, -1, -(1 << 63), 123456789012345]
    bits = suffix_tree_lm.key_map(spark.createDataFrame([(k,) for k in keys], "key long"))
    low = {k & ((1 << suffix_tree_lm.MAP_BITS) - 1) for k in keys}
    assert bits.dtype == np.uint32 and len(bits) == 1 << (suffix_tree_lm.MAP_BITS - 5)
    assert {int(w) * 32 + b for w in np.flatnonzero(bits) for b in range(32) if bits[w] >> np.uint32(b) & 1} == low
    assert not suffix_tree_lm.key_map(spark.createDataFrame([], "key long")).any()


def test_state_distributions_sum_to_one():
    """Of the plain tree, which the operator's scores equal."""
    _, states, p, unigrams = tree_by_hand(phrases(6))
    words = [*unigrams, "any unknown word"]
    assert {len(c) for c in states} == {1, 2}
    for context in [(), *states]:
        assert math.isclose(sum(p(context, w) for w in words), 1.0, rel_tol=1e-9)


def test_grams_with_like_numbers_are_counted_apart():
    """Words whose numbers share their leading bits (as many words do) still
    get whole counts."""
    plain = suffix_tree_lm.word_hashes

    def alike(texts):
        hashes, ends = plain(texts)
        return hashes & np.uint64(0xFFFF) | np.uint64(1 << 60), ends
    rng = random.Random(3)
    tokens = [f"w{rng.randrange(12)}" for _ in range(4000)]
    numbers = alike([" ".join(tokens)])[0]
    context, suffix = numbers[:-1], numbers[1:]
    got = suffix_tree_lm._summed(context, suffix, np.ones(len(context), int), suffix_tree_lm.joined_id(context, suffix))
    assert sorted(zip(*(a.tolist() for a in got[:3]))) == sorted(
        (int(a), int(b), n) for (a, b), n in Counter(zip(context.tolist(), suffix.tolist())).items())


def test_events_of_a_frequent_context_are_dealt_out(spark, monkeypatch):
    """Counts do not depend on how contexts are dealt to buckets."""
    monkeypatch.setattr(suffix_tree_lm, "COUNTED", 300)
    rows = [(i, " ".join("the " + w for w in t.split())) for i, t in phrases(9, 100)]
    df = docs(spark, rows)
    counts = suffix_tree_lm.count_symbols(df)
    total = counts.agg(F.sum("n")).first()[0]
    for share in (total, 0):
        events = suffix_tree_lm.count_events(df, counts.select("key", F.col("n").alias("c")), 2, share).collect()
        want = Counter(p for _, t in rows for p in zip(t.split(), [*t.split()[1:], ""]))
        assert sorted(r["n"] for r in events) == sorted(n for n in want.values() if n > 1)


def test_lookup_finds_every_key():
    rng = np.random.default_rng(1)
    keys = rng.choice(1 << 40, 5000, replace=False).astype(np.uint64)
    table_ = suffix_tree_lm.Lookup(keys)
    others = np.setdiff1d(rng.integers(0, 1 << 40, 5000).astype(np.uint64), keys)
    assert np.array_equal(table_.find(keys), np.arange(len(keys)))
    assert (table_.find(others) == -1).all() and len(suffix_tree_lm.Lookup(keys[:0]).find(keys[:3])) == 3


def test_language_model_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a a A"), (3, "a a A"), (4, "é É"), (5, "w " * 30_000), (None, "a"), (7, "\x00 b")]
    got = suffix_tree_lm.score_documents(clashing(docs(spark, rows))).collect()
    want = base_by_hand(rows)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], score, rel_tol=1e-9) and r["score"] < 0
    assert suffix_tree_lm.score_documents(docs(spark, rows).limit(0)).count() == 0
    only_held = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert {(r["score"], r["base_score"], r["n_known"]) for r in suffix_tree_lm.score_documents(
        docs(spark, only_held)).collect()} == {(0.0, 0.0, 0)}


# --- Jaccard join -----------------------------------------------------------------

def shingle_set(text):
    words = lowered(text).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))


def components_by_hand(rows, threshold=80):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, families=6, size=14, words=120):
    """Families of edited copies around the threshold, chains among them, and
    a passage that most texts share."""
    rng = random.Random(seed)
    passage = " ".join(f"shared{k}" for k in range(25))
    rows = []
    for f in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        chain = list(base)
        for _ in range(size):
            text = list(chain if rng.random() < 0.5 else base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            chain = text
            rows.append(" ".join(text) + (" " + passage if rng.random() < 0.7 else ""))
    rows += [passage, passage.upper(), passage + " more", "a b", "a  B", "a b c", "", "one two three four five"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed,frequent", [(1, 100_000), (2, 0), (3, 10)])
def test_similar_components_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard_join.similar_components(docs(spark, rows)).collect()}
    want = components_by_hand(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 20


@pytest.mark.parametrize("frequent", [0, 10])
def test_the_order_of_shingles_is_cut_at_frequent(spark, monkeypatch, frequent):
    df = docs(spark, near_copies(1))
    uncut = len(jaccard_join.frequent_shingles(df, 5))
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    assert len(jaccard_join.frequent_shingles(df, 5)) <= frequent < uncut


def test_similar_components_edge_rows(spark):
    long = " ".join(f"x{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "A b c d e f g"), (None, "alone here"),
            (5, long), (6, long + " y"), (7, " \t\n")]
    df = clashing(docs(spark, rows))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(df).collect())
    assert got == Counter([(1, 0, 1), (2, 0, 2), (3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 1, None), (5, 19_996, 5),
                           (6, 19_997, 5), (7, 0, 7)])
    kept = jaccard_join.drop_similar(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 3, None, 5, 7])
    assert jaccard_join.similar_components(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5)] + [(259, 300), (300, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 7 for k in [*range(100, 161), *range(200, 260), 300]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cut_leaves_at_most_the_limit(spark):
    rows = spark.createDataFrame([(k,) for k in [1] * 50 + [2] * 20 + [3, 5, 9, 1000]], "n long")
    for limit in (0, 1, 3, 4, 30, 100):
        least = jaccard_join.cut_at(rows, "n", limit)
        assert rows.filter(F.col("n") >= least).count() <= limit or limit >= 74
    assert jaccard_join.cut_at(rows, "n", 100) == 1


# --- decontamination -----------------------------------------------------------------

def leaks_by_hand(rows, items, threshold=80):
    out = set()
    for i, t in rows:
        own, words = shingle_set(t), [w.decode() for w in words_of(t)]
        for k, item in items:
            s, run = shingle_set(item), [w.decode() for w in words_of(item)]
            if 0 < len(run) < 5:
                if any(words[at:at + len(run)] == run for at in range(len(words))):
                    out.add((i, k, 1, 1))
            elif s and 100 * len(s & own) >= threshold * len(s):
                out.add((i, k, len(s & own), len(s)))
    return out


def leak_case(seed):
    rng = random.Random(seed)
    def text(n):
        return [f"t{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate([1, 3, 5, 6, 8, 11, 15, 20, 33, 40, 64, 100, 300])]
    rows = []
    for i in range(80):
        body = text(rng.choice([0, 3, 10, 200, 3000]))
        for _ in range(rng.choice([0, 1, 2])):
            item = list(rng.choice(items)[1])
            if len(item) > 10 and rng.random() < 0.4:
                item[rng.randrange(len(item))] = "edited"
            at = rng.randrange(len(body) + 1)
            body[at:at] = item
        rows.append((i, " ".join(body)))
    return rows, [(k, " ".join(t)) for k, t in items]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contamination_brute_force(spark, seed):
    rows, items = leak_case(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"])
           for r in decontamination.contamination(docs(spark, rows), bench).collect()}
    want = leaks_by_hand(rows, items)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 20
    # Blocks of items give the same pairs.
    parted = decontamination.contamination(docs(spark, rows), bench, item_block=4)
    assert {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in parted.collect()} == got
    clean = {r["doc_id"] for r in decontamination.drop_contaminated(docs(spark, rows), bench, item_block=5).collect()}
    assert clean == {i for i, _ in rows} - {g[0] for g in got}


def test_contamination_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in decontamination.contamination(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")).collect()}
    assert got == leaks_by_hand(rows, items)


def test_contamination_edge_rows(spark):
    item = "one two three four five six seven"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (4, "short")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "x " * 60_000 + item.upper()), (None, item), (5, "SHORT"), (5, "SHORT"), (6, "short one")]
    df = clashing(docs(spark, rows)).withColumn("item_id", F.lit("z"))
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.contamination(df, bench).collect())
    assert got == Counter([(3, 1), (None, 1), (5, 4), (5, 4), (5, 4), (5, 4), (6, 4), (6, 4)])
    kept = decontamination.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert decontamination.contamination(df.limit(0), bench).count() == 0
    assert decontamination.contamination(df, bench.limit(0)).count() == 0


def test_short_items_sql(spark):
    """Items of one to four words inside documents, by the query's SQL."""
    rows = [(1, "a b c d e f g"), (2, "c d"), (3, "b c x d"), (4, "c"), (5, None), (6, "x  C\td e")]
    items = [(1, "c d"), (2, "b c d e"), (3, "x"), (4, "d e f g"), (5, "c d"), (6, "a b c d e f"), (7, "q")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = {r[:4] for r in con.execute(queries.ORACLE_SQL["op8_decontamination"]).fetchall()}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in decontamination.contamination(docs(spark, rows), bench).collect()}
    assert got == want == leaks_by_hand(rows, items) and len(got) > 8


# --- token counts --------------------------------------------------------------------

def reference_tokenizer(vocabulary):
    from tokenizers import Tokenizer, models, normalizers
    pieces = [("<unk>", 0.0), *vocabulary.items()] + [(f"<0x{b:02X}>", min(vocabulary.values())) for b in range(256)]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_token_counts_match_the_unigram_tokenizer(spark):
    vocabulary = token_counts.load_vocabulary()
    counter, reference = token_counts.PieceCounter(vocabulary), reference_tokenizer(vocabulary)
    texts = [r["text"] for r in table(spark, SF, "documents").select("text").collect()]
    rng = random.Random(2)
    alphabet = "aeinrst  \n\t.é😀中▁"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)]
    for text in texts:
        assert counter.count(text)[1] == len(reference.encode(text, add_special_tokens=False).ids), text


def test_viterbi_against_all_segmentations():
    rng = random.Random(4)
    for _ in range(150):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): float(-rng.randrange(4))
                      for _ in range(7)}
        counter = token_counts.PieceCounter(vocabulary)
        text = "".join(rng.choice("abcd") for _ in range(9))
        best = [(0.0, [])] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                part = text[start:end]
                score = vocabulary.get(part, counter.unknown_score if end - start == 1 else None)
                if score is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                    best[end] = best[start][0] + score, best[start][1] + [part]
        score, pieces, unknown = counter.viterbi(text)
        assert score == best[-1][0] and pieces == len(best[-1][1])
        assert unknown == sum(p not in vocabulary for p in best[-1][1])


def test_token_count_edge_rows(spark):
    vocabulary = token_counts.load_vocabulary()
    rows = [(1, None), (2, ""), (3, "é" * 50_000), (4, "a " * 50_000), (4, "a " * 50_000), (None, "x\n\ny")]
    got = token_counts.count_tokens(clashing(docs(spark, rows)), vocabulary).collect()
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0] and len(got) == 6
    reference = reference_tokenizer(vocabulary)
    by_id = dict(rows)
    assert all(r["n_tokens"] == len(reference.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids)
               for r in got if by_id[r["doc_id"]])
    assert token_counts.count_tokens(docs(spark, rows).limit(0), vocabulary).count() == 0


def test_words_split_on_ascii_white_space_only():
    assert words_of("A\x0bB\x1c\xa0É") == ["a".encode(), "b\x1c\xa0É".encode()]


def test_word_hashes_tell_words_apart(monkeypatch):
    rng = random.Random(8)
    texts = [None, "", " \n", "a", "A a\0 aa ab ba"] + [
        " ".join("".join(rng.choice("abé\x01") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(60)))
        for _ in range(300)] + ["x" * 5000 + " y"]
    whole, ends = common.word_hashes(texts)
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    assert np.array_equal(common.word_hashes(texts)[0], whole)
    seen, start = {}, 0
    for text, end in zip(texts, ends):
        words = words_of(text)
        assert end - start == len(words)
        for word, value in zip(words, whole[start:end].tolist()):
            assert seen.setdefault(word, value) == value
        start = end
    assert len(set(seen.values())) == len(seen) > 1000
    # Shingle sets have the sizes of the sets of word sequences.
    assert [len(s) for s in common.shingle_sets(texts, 5)] == [len(shingle_set(t)) for t in texts]
