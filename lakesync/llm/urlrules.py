"""URL filters: longest-match rules and mined token combinations (operator 7).

Given rules (host suffix and path prefix) decide the urls they fit.  Their
verdicts label those urls; Spark's FP-growth mines which combinations of url
tokens go with ``block``, rules below the support or confidence are pruned, and
so is every rule that a shorter kept rule implies.  Urls without a given rule
are matched through an inverted index: a mined rule is filed under its rarest
token only, and its other tokens are tested on the urls that have that token.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import stored

ALLOW, BLOCK = "allow", "block"
#: The item that stands for the verdict among a url's tokens.
BLOCKED = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column, host_col: Column, path_col: Column) -> Column:
    """Distinct tokens of a url: host suffixes and first label, path segments' heads, extension, query keys, scheme, fragment."""
    label = F.split(host_col, r"\.")
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    segment = F.element_at(F.split(path_col, "/"), 2)
    named = F.array(
        F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))),
        F.concat(F.lit("tld:"), F.element_at(label, -1)),
        F.when(F.size(label) > 1, F.concat(F.lit("domain:"), F.substring_index(host_col, ".", -2))),
        F.when(F.size(label) > 2, F.concat(F.lit("sub:"), F.element_at(label, 1))),
        F.concat(F.lit("host:"), host_col),
        F.when(F.size(F.split(path_col, "/")) > 1, F.concat(F.lit("dir:"), F.regexp_replace(segment, r"\d+", "0"))),
        F.when(path_col.rlike(r"\.[A-Za-z0-9]{1,6}$"), F.concat(F.lit("ext:"), F.regexp_extract(path_col, r"\.([A-Za-z0-9]{1,6})$", 1))),
        F.when(F.contains(url, F.lit("#")), F.lit("fragment")))
    keys = F.transform(F.filter(query, lambda q: q != ""), lambda q: F.concat(F.lit("key:"), F.substring_index(q, "=", 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(named, keys), lambda t: t.isNotNull())))


def rule_name(rules: Sequence[tuple[str, str, str]], host_col: Column, path_col: Column) -> Column:
    """``host/path`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def mine(items: DataFrame, min_support: float, min_confidence: float, min_count: int = 10) -> DataFrame:
    """rule_tokens, confidence, support of the shortest token combinations that go with ``BLOCKED``.

    A combination must hold in the share ``min_support`` of the rows and in ``min_count`` rows.

    ``items``: one array of distinct tokens a row, ``BLOCKED`` among them where
    the url is blocked.  No row: no rule."""
    rows = items.count()
    if rows < min_count:
        return items.sparkSession.createDataFrame([], "rule_tokens array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / rows), minConfidence=min_confidence).fit(items)
    found = stored(model.associationRules.where(F.element_at("consequent", 1) == BLOCKED)
                   .select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support"), "url-rules")
    # a rule whose tokens less one are a rule too adds nothing
    implied = (found.where(F.size("rule_tokens") > 1).select("rule_tokens", F.explode("rule_tokens").alias("less"))
               .select("rule_tokens", F.array_remove("rule_tokens", F.col("less")).alias("parent"))
               .join(found.select(F.col("rule_tokens").alias("parent")), "parent", "left_semi").select("rule_tokens").distinct())
    return found.join(implied, "rule_tokens", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` of ``urls`` (url, tokens) that hold all tokens of a rule."""
    # only the tokens of rules are counted, so their counts follow the rules
    in_rules = rules.select(F.explode("rule_tokens").alias("token")).distinct()
    counts = (urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
              .join(in_rules, "token", "right").select("token", F.coalesce("n", F.lit(0)).alias("n")))
    rarest = (rules.select("rule_tokens", F.explode("rule_tokens").alias("token")).join(counts, "token")
              .groupBy("rule_tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token")))
    return (urls.select("url", "tokens", F.explode("tokens").alias("token")).join(rarest, "token")
            .where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("url").distinct())


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], min_support: float = 0.005, min_confidence: float = 0.9,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``rules``: (host, path prefix, verdict).  A url without a fitting rule is
    blocked if a mined rule matches, else allowed; so are null urls and urls
    without ``://``, whose host and path are empty.  Null and repeated ids are
    carried row by row; other columns are ignored."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parts = own.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    parts = parts.withColumn("rule", rule_name(rules, F.col("host"), F.col("path")))
    verdict = F.lit(None).cast("string")
    for h, p, v in rules:
        verdict = F.when(F.col("rule") == h + p, F.lit(v)).otherwise(verdict)
    parts = parts.withColumn("given", verdict)
    token_list = tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = parts.where("given is not null").select(
        F.when(F.col("given") == BLOCK, F.array_append(token_list, F.lit(BLOCKED))).otherwise(token_list).alias("items"))
    mined = mine(labelled, min_support, min_confidence)
    # a url is judged once, however many pages have it
    others = parts.where("given is null and host <> ''").groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"))
    hits = matched(others.select("url", token_list.alias("tokens")), mined).withColumn("hit", F.lit(True))
    return (parts.join(hits, "url", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("given", F.when(F.col("hit"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict")))


__all__ = ["host", "path", "tokens", "rule_name", "mine", "matched", "judge"]
