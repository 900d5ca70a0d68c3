"""URL filters (DataFrame only): block and allow rules by longest match, and
logistic regression on hashed character n-grams of host and path for the
URLs that no rule settles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The labelled URLs that the classifier learns from: (url, 1 = block).
LABELLED_URLS = (
    ("https://www.cheap-pills.example.net/en/1", 1), ("http://cheap-meds.example.org/de/77?ref=x", 1),
    ("https://m.spam-farm.example.com/es/12.html", 1), ("http://link-farm.example.net/fr/9", 1),
    ("https://casino-bonus.example.org/en/bonus", 1), ("http://free-casino.example.net/de/slots.html", 1),
    ("https://best-replica-watches.example.com/shop/", 1), ("http://win-prizes-now.example.net/claim", 1),
    ("https://adult-cams.example.org/live/3", 1), ("http://torrent-warez.example.net/crack/44.html", 1),
    ("https://payday-loans.example.com/apply?now=1", 1), ("http://seo-backlinks.example.org/buy/", 1),
    ("https://click-bait.example.net/track?aff=7", 1), ("http://cheap-viagra.example.com/pills/5", 1),
    ("https://spam-blog.example.org/en/100", 1), ("http://free-download-keygen.example.net/serial", 1),
    ("https://porn-tube.example.net/video/8", 1), ("http://lottery-winner.example.org/claim/2.html", 1),
    ("https://crypto-doubler.example.com/invest", 1), ("http://fake-diploma.example.net/buy/degree", 1),
    ("https://www.university.example.org/en/courses/12", 0), ("http://library.example.net/de/catalog/3.html", 0),
    ("https://blog.science.example.com/en/2024", 0), ("http://news.example.org/en/politics/81", 0),
    ("https://docs.python.example.org/tutorial.html", 0), ("http://m.weather.example.net/de/11709/", 0),
    ("https://wiki.history.example.org/article/77", 0), ("http://www.museum.example.net/en/visit#top", 0),
    ("https://blog.travel.example.org/en/968.html", 0), ("http://m.transit.example.net/en/46931", 0),
    ("https://bookshop.example.net/en/36608", 0), ("http://www.theatre.example.org/de/34481?page=2", 0),
    ("https://archive.example.net/de/1511.html", 0), ("http://research.example.org/en/papers/5", 0),
    ("https://www.hospital.example.net/en/contact", 0), ("http://city-council.example.org/en/minutes/9", 0),
    ("https://school.example.com/en/lessons/4", 0), ("http://cooking.example.net/en/recipes/31.html", 0),
    ("https://garden.example.org/de/plants/6", 0), ("http://music.example.net/en/reviews/200", 0),
)

FEATURES = 4096
GRAM_WIDTHS = (3, 4)
STEPS = 25
STEP_SIZE = 4.0


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path).  Host: after the first ``://`` up to ``/ ? #`` or the
    end, A-Z lower-cased; path: from there up to ``? #`` or the end.  A null
    url or one without ``://`` has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null without one."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, prefix in reversed(by_length):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(rule_host + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: Column, path: Column, features: int = FEATURES) -> Column:
    """Hash buckets of the distinct character n-grams of host and path."""
    def grams(tag: str, text: Column, width: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - width + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(tag), F.substr(marked, i, F.lit(width))))
    parts = [grams(tag, text, w) for tag, text in (("h", host), ("p", path)) for w in GRAM_WIDTHS]
    return F.array_distinct(F.transform(F.concat(*parts), lambda g: F.pmod(F.xxhash64(g), F.lit(features)).cast("int")))


def margin(buckets: Column, weights: list[float], bias: float) -> Column:
    """Linear score of a unit-length bag of n-grams."""
    held = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(held, b))
    return total / F.sqrt(F.size(buckets).cast("double")) + F.lit(bias)


def labelled_table(spark: SparkSession) -> DataFrame:
    """The small labelled URL table (url, label)."""
    rows = ", ".join(f"('{url}', {label})" for url, label in LABELLED_URLS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def train(labelled: DataFrame, features: int = FEATURES, steps: int = STEPS) -> tuple[list[float], float]:
    """Logistic regression by batch gradient descent on a small labelled table
    (url, label).  Each step is one DataFrame aggregation; the driver holds
    the weight vector alone, whose length is ``features``."""
    host, path = split_url(F.col("url"))
    rows = labelled.filter("label IS NOT NULL").select(
        gram_buckets(host, path, features).alias("buckets"), F.col("label").cast("double").alias("y")).persist()
    try:
        n = rows.count()
        weights, bias = [0.0] * features, 0.0
        for _ in range(steps if n else 0):
            miss = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(F.col("buckets"), weights, bias))) - F.col("y")
            steps_of = rows.select("buckets", miss.alias("miss")).select(
                F.explode(F.concat(F.array(F.lit(-1)), "buckets")).alias("bucket"),
                "miss", F.sqrt(F.size("buckets").cast("double")).alias("norm"))
            grads = steps_of.groupBy("bucket").agg(
                F.sum(F.when(F.col("bucket") < 0, F.col("miss")).otherwise(F.col("miss") / F.col("norm"))).alias("g"))
            for r in grads.collect():
                if r["bucket"] < 0:
                    bias -= STEP_SIZE * r["g"] / n / 4
                else:
                    weights[r["bucket"]] -= STEP_SIZE * r["g"] / n
        return weights, bias
    finally:
        rows.unpersist()


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    ``score`` is the classifier's probability of a block, given for every URL;
    it decides (0.5 or more blocks) where no rule fits.  Of rules of one length
    the first by host and path wins (the given ones never fit
    one URL together); a very long URL has more n-grams.  Null URLs and such
    without ``://`` have empty host and path and are judged like any other;
    repeated rows are judged alike, an empty table gives no rows, and further
    columns are not read.
    """
    weights, bias = train(labelled)
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(gram_buckets(F.col("host"), F.col("path")), weights, bias)))
    scored = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("says"), score.alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        "says", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
