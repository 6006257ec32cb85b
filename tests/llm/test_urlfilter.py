from __future__ import annotations

import random

from pyspark.sql import Row

from stridelab.llm import queries, urlfilter
from tests.oracle import compare, connect


def plain(url: str | None, rules: list[tuple[str, str, str]]) -> tuple[str, str, str | None, str]:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(8)
    label = lambda: rng.choice(["com", "net", "example", "a", "b", "www", "É", "X"])
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((".".join(label().lower() for _ in range(rng.randint(1, 3))), rng.choice(["/", "", "/en", "/en/", "/en/7", "/d", "/en/71"])) for _ in range(40))}.values())
    urls = [None, "", "no scheme", "http://", "http://com", "HTTP://A.Com/en/712?x#y", "a://b://com/en", "http://x.com\n/en/7", "http://com:80/en/", "http://u@a.com/en/7#?"]
    urls += [f"http://{'.'.join(label() for _ in range(rng.randint(1, 5)))}{rng.choice(['', '/', '/en/', '/en/7', '/en/71/2', '/EN/7', '/d?/en/', '#/en'])}" for _ in range(300)]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    for few in (urlfilter.BROADCAST_RULES, 0):
        got = urlfilter.judge(rows, spark.createDataFrame(rules, "host string, path string, action string"), broadcast_rules=few).collect()
        assert {r.id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rules = spark.createDataFrame([("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block"), ("net", None, "block")], "host string, path string, action string")
    rows = [Row(url="http://a.com/x", host="old", rule=3, h="h", p="p", prefix="q"), Row(url="http://a.com/x", host="old", rule=3, h="h", p="p", prefix="q"), Row(url=None, host=None, rule=None, h=None, p=None, prefix=None)]
    df = spark.createDataFrame(rows, "url string, host string, rule int, h string, p string, prefix string")
    out = urlfilter.judge(df, rules)
    assert out.columns == ["url", "h", "p", "prefix", "host", "path", "rule", "verdict"]
    assert sorted((r.url or "", r.host, r.rule, r.verdict, r.h) for r in out.collect() if r.url) == [("http://a.com/x", "a.com", "com/", "block", "h")] * 2
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    assert [r.verdict for r in urlfilter.judge(df, rules.limit(0)).collect()] == ["allow"] * 3


def test_query_matches_its_sql(spark, sf_dir):
    name = "op6_url_filter"
    assert compare(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name]) is None
