"""Exact dedup, chat formatting, mixing and URL filters against brute force."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assetlens.llm import chat_format, exact_dedup, mixing, url_filter
from assetlens.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], DOCS)


LONG = " ".join(f"word{i % 977} of the third land" for i in range(4000))
TEXTS = [(1, "Same"), (2, "sAME"), (3, None), (4, ""), (5, LONG), (6, LONG.upper()), (7, LONG + "x"), (8, "É"),
         (9, "é"), (2, "sAME"), (None, "Same"), (None, "only here"), (10, "x" * 20_000), (11, "x" * 20_001)]


def test_exact_groups_brute_force(spark):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(docs(spark, TEXTS)).collect()}
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[lowered(t)].append(i)
    for i, t in TEXTS:
        r = got[i, hashlib.sha256(lowered(t).encode()).hexdigest()]
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), i == keep)


def test_exact_groups_of_nothing_and_clashing_columns(spark):
    empty = docs(spark, TEXTS).limit(0)
    assert exact_dedup.exact_groups(empty).count() == 0
    odd = docs(spark, TEXTS).withColumns({c: F.lit("x") for c in ("recipe", "kept", "keep_id", "norm", "h")})
    assert exact_dedup.exact_groups(odd).count() == len(TEXTS)
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 4, 6, 7, 8, 9, 10, 11]


def test_chunks_join_to_the_text_and_follow_content(spark):
    df = docs(spark, [(5, LONG), (7, "new start " + LONG), (3, None), (8, "a\n\n" * 9000)])
    rows = df.select("doc_id", exact_dedup.ascii_lower(F.col("text")).alias("t")).select(
        "doc_id", "t", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert all("".join(r["c"]) == r["t"] for r in rows)
    assert all(len(c) <= exact_dedup.MAX_CHUNK for r in rows for c in r["c"])
    # After an insertion most chunks are the old ones again.
    assert len(set(by_id[5]["c"]) & set(by_id[7]["c"])) > 0.5 * len(set(by_id[5]["c"]))


def test_colliding_hashes_are_told_apart_by_their_text(spark):
    df = docs(spark, [(1, "one"), (2, "two"), (3, "one")])
    norm = exact_dedup.ascii_lower(F.col("text"))
    hashes = [r[0] for r in df.select(F.xxhash64(F.lit(0), norm)).collect()]
    forced = {r["doc_id"]: r["r"] for r in df.select("doc_id", exact_dedup.recipe(norm, 0, hashes).alias("r")).collect()}
    assert forced[1] == forced[3] != forced[2] and "=" in forced[1]


TURNS = [(1, 0, "user", "hi"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user"),
         (1, 3, "assistant", "a<\\|b<|"), (2, 0, None, "x"), (2, 1, "role\nwith <|im_sep|> % line", ""),
         (3, 1, "assistant", "second"), (3, 1, "assistant", "first"), (3, None, "system", "é😀"),
         (None, 0, "assistant", "no id")]
CHAT = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, CHAT).withColumns({"segments": F.lit(1), "blocks": F.lit(2)})
    chats = chat_format.format_chat(turns)
    got = {r["conv_id"]: r for r in chat_format.formatted_digests(chats).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(TURNS, key=lambda r: (str(r[0]), (r[1] is not None, r[1] or 0), r[2] or "",
                                                               r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, rows in want.items():
        r = got[conv]
        loss = "".join(t for role, t in rows if role == "assistant")
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(texts[conv])
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(rows, rows[1:]))
        assert texts[conv].count("<|im_start|>") == texts[conv].count("<|im_end|>") == blocks
        assert texts[conv].count("<|im_sep|>") == len(rows) - blocks
    segments = {r["conv_id"]: r["segments"] for r in chats.collect()}
    assert all("".join(s["text"] for s in segments[c]) == texts[c] for c in texts)


def test_chat_of_nothing_and_long_conversation(spark):
    empty = spark.createDataFrame([], CHAT)
    assert chat_format.formatted_digests(chat_format.format_chat(empty)).count() == 0
    long = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role",
                                        "repeat('y', 50) AS text")
    r = chat_format.formatted_digests(chat_format.format_chat(long)).first()
    assert r["n_turns"] == 3000 and r["loss_chars"] == 2000 * 50


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|x", "\\|", "<<||", "<|im_start|>", "<\\", "|>", ""])
def test_escape_is_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    e, back = df.select(chat_format.escape(F.col("t")), chat_format.unescape(chat_format.escape(F.col("t")))).first()
    assert back == text and "<|" not in e


def targets_by_hand(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_of_the_documents(spark):
    rows = mixing.mix(table(spark, SF, "documents").drop("lang")).collect()
    words, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(r["text"].encode().split())
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        words[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    target = targets_by_hand(words)
    largest = max(r["size"] for r in rows)
    for r in rows:
        assert r["source_size"] == words[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= largest for s in words)
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) < 3 * largest


def test_mix_of_a_hot_source_comes_near_its_target(spark):
    df = spark.range(6000).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(5 + id % 97 AS INT)) AS text",
        "CASE WHEN id < 2000 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('s', id % 4) END AS source",
        "1 AS size", "'x' AS target", "2 AS __x")
    rows = mixing.mix(df)
    sums = rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) < 0.02 * r["t"] for r in sums)
    again = mixing.mix(df.repartition(7))
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))
    assert mixing.emit_copies(rows).count() == rows.agg(F.sum("copies")).first()[0]


def test_mix_edge_rows(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, " \t\n")])
    rows = mixing.mix(df).collect()
    assert len(rows) == 6 and {r["source_size"] for r in rows} == {5}
    assert {r["target"] for r in rows} == {7.5}
    assert mixing.mix(df.limit(0)).count() == 0
    silent = mixing.mix(docs(spark, [(1, None), (2, "")])).collect()
    assert [(r["target"], r["taken"]) for r in silent] == [(0.0, 0), (0.0, 0)]


URLS = ["https://WWW.Example.com/en/1", "http://a.example.com/en/", "https://x.com", "https://x.com/", "http://b.net/fr/2#x",
        "ftp://net/es/?q", "no scheme", None, "", "http://h?q=/en/", "https://a.org://b/c", "http://examplE.com/en/x?y",
        "http://myexample.com/en/", "http://é.NET/fr/", "://only.com/a"]


def judged_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = lowered(rest[:cut]), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns(
        {"host": F.lit("x"), "rule": F.lit(1), "label": F.lit(2)})
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, url_filter.labelled_table(spark)).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = judged_by_hand(url)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
        assert 0 < r["score"] < 1


def test_url_classifier_learns_its_table_and_carries_over(spark):
    weights, bias = url_filter.train(url_filter.labelled_table(spark))
    unseen = [("https://www.cheap-replica.example.org/de/9", 1), ("http://best-casino-bonus.example.net/en/4", 1),
              ("https://news.university.example.org/en/77", 0), ("http://library.museum.example.net/de/8", 0)]
    df = spark.createDataFrame([(u, y) for u, y in [*url_filter.LABELLED_URLS, *unseen]], "url string, y int")
    host, path = url_filter.split_url(F.col("url"))
    rows = df.select("y", url_filter.margin(url_filter.gram_buckets(host, path), weights, bias).alias("m")).collect()
    right = [(r["m"] >= 0) == bool(r["y"]) for r in rows]
    assert sum(right[:-4]) >= 0.95 * len(right[:-4]) and all(right[-4:])


def test_mix_and_urls_of_very_long_texts(spark):
    df = docs(spark, [(1, "w " * 300_000), (2, "a b"), (3, "x" * 400_000)])
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()} == {1: 300_000, 2: 2, 3: 1}
    url = "https://WWW.example.com/en/" + "abc/" * 4_000 + "?q=1"
    pages = spark.createDataFrame([(1, url), (2, url)], "page_id long, url string")
    rows = url_filter.judge_urls(pages, url_filter.labelled_table(spark)).collect()
    assert {(r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in rows} == {
        ("www.example.com", 4 + 16_000, "www.example.com/en/", "allow")}


def test_urls_without_labels_or_pages(spark):
    none = url_filter.labelled_table(spark).limit(0)
    pages = spark.createDataFrame([(1, "https://a.org/x"), (1, "https://a.org/x")], "page_id long, url string")
    assert {r["score"] for r in url_filter.judge_urls(pages, none).collect()} == {0.5}
    assert url_filter.judge_urls(pages.limit(0), url_filter.labelled_table(spark)).count() == 0
