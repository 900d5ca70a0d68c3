"""The corpus pipeline, stage by stage, and the registration of the queries."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from assetlens.llm import queries, toxicity
from assetlens.llm.common import shared_table, table

SF = "/root/testdata/sf0.01"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    words = lowered(text).encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def stage(spark, name, docs, sf_dir=SF):
    return shared_table(dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir), "test-" + re.sub(r"\W", "-", name))


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, *model).filter("predicted = 1").collect()}
    rows = {i: t for i, t in rows.items() if i not in bad}
    out = stage(spark, "toxicity", docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(rows) and bad

    largest = {}
    for i, t in rows.items():
        largest[lowered(t)] = max(i, largest.get(lowered(t), i))
    rows = {i: t for i, t in rows.items() if largest[lowered(t)] == i}
    out = stage(spark, "exact dedup", out)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(rows)

    sets = {i: shingle_set(t) for i, t in rows.items()}
    places, shared = {}, Counter()
    for i, s in sets.items():
        for x in s:
            for other in places.setdefault(x, []):
                shared[other, i] += 1
            places[x].append(i)
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    rows = {i: t for i, t in rows.items() if find(i) == i}
    out = stage(spark, "n-gram Jaccard join", out)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(rows)

    items = [shingle_set(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = {i: t for i, t in rows.items() if not any(s and 100 * len(s & sets[i]) >= 80 * len(s) for s in items)}
    out = stage(spark, "benchmark decontamination", out)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(rows)

    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, out, SF).collect()
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(rows) and max(copies.values()) <= 2
    assert all(r["copies"] == copies[r["doc_id"]] and r["text"] == rows[r["doc_id"]] for r in mixed)
    # run() is the stages one after another.
    again = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect())
    assert again == copies


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5),
            (None, "one two three four five six", "de", "b", None), (4, "long " * 50_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"score": F.lit("x"), "node": F.lit(1), "recipe": F.lit(2), "item_id": F.lit(3)})
    for frame, n in ((docs, 4), (docs.limit(0), 0)):
        for name, _ in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, name, frame)
            assert frame.columns == docs.columns
        # Equal texts: the null and the empty one, and the repeated row.
        assert frame.count() == n
        assert stage(spark, "mixing", frame).count() >= (1 if n else 0)


def test_queries_are_registered(spark):
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and "pipeline" not in E.oracle_sql()
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v
    want = Counter(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want
