"""Operator 7 against plain Python on small fixtures."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from lakesync.llm import urlrules
from lakesync.llm.queries import URL_RULES


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def longest(host, path):
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


AWKWARD = [None, "", "nothing", "http://", "://", "HTTP://WWW.Example.COM/en/1", "http://example.com", "http://example.com/", "http://xample.com/en/",
           "http://notexample.com/en/", "http://a.www.example.com/en/x?y=http://b/c", "ftp://x.net/es/1#f", "http://x.net?/es/", "http://net/fr/",
           "a://b://c/d", "http://é.net/es/É", "http://x.net/es", "http://h/\nline", "http://ÀB.org/Z"]


def pages(spark, urls):
    return (spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
            .withColumn("host", F.lit("extra")).withColumn("token", F.lit("extra")).withColumn("rule", F.lit("extra")))


def test_host_path_and_rules(spark):
    rows = urlrules.judge(pages(spark, AWKWARD), URL_RULES).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        host, path = split_url(AWKWARD[r.page_id])
        assert (r.host, r.path) == (host, path), AWKWARD[r.page_id]
        name, verdict = longest(host, path)
        assert r.rule == name and r.verdict == (verdict or "allow")


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(4)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'b', 'spam'])}.{rng.choice(['x.org', 'y.net', 'z.com', 'spam.io'])}"
            f"/{rng.choice(['en', 'es', 'fr'])}/{rng.randint(1, 50)}{rng.choice(['', '.html', '?q=1', '#t'])}" for _ in range(300)]
    df = pages(spark, urls).select("url", urlrules.host(F.col("url")).alias("h"), urlrules.path(F.col("url")).alias("p"))
    data = [(r.url, r.t) for r in df.select("url", urlrules.tokens(F.col("url"), F.col("h"), F.col("p")).alias("t")).collect()]
    items = [t + ([urlrules.BLOCKED] if "spam" in u and "/es/" in u else []) for u, t in data]
    got = urlrules.mine(spark.createDataFrame([(i,) for i in items], "items array<string>"), 0.05, 0.9)
    both, alone = {}, {}
    for i in items:
        tokens = [t for t in i if t != urlrules.BLOCKED]
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                alone[c] = alone.get(c, 0) + 1
                both[c] = both.get(c, 0) + (urlrules.BLOCKED in i)
    rules = {c for c, n in both.items() if n >= 0.05 * len(items) and n / alone[c] >= 0.9}
    least = {c for c in rules if not any(tuple(x for x in c if x != t) in rules for t in c)}
    assert {tuple(r.rule_tokens) for r in got.collect()} == least and least
    hits = urlrules.matched(spark.createDataFrame(data, "url string, tokens array<string>"), got)
    assert {r.url for r in hits.collect()} == {u for u, t in data if any(set(c) <= set(t) for c in least)}


def test_method_decides_urls_without_a_rule(spark):
    """Blocked by given rules on .net, the same tokens block elsewhere."""
    urls = [f"http://spam{i}.net/es/{i}?pill=1" for i in range(60)] + [f"http://ok{i}.com/en/{i}" for i in range(60)]
    urls += ["http://other.org/es/9?pill=1", "http://other.org/en/9"]
    got = {r.page_id: r.verdict for r in urlrules.judge(pages(spark, urls), URL_RULES).collect()}
    assert got[120] == "block" and got[121] == "allow"


def test_repeats_and_empty(spark):
    df = pages(spark, ["http://x.net/es/1"] * 5 + [None] * 3)
    assert urlrules.judge(df, URL_RULES).count() == 8
    assert urlrules.judge(df.limit(0), URL_RULES).count() == 0
    plan = urlrules.judge(df, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
