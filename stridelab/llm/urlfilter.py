"""URL rules by hashed host-suffix and path-prefix expressions.

Every url is expanded into the expressions that a rule for it could have: each
suffix of its host joined with each beginning of its path, of only those
lengths that rules have. Expressions meet rules on the first bytes of their
SHA-256 digests; the full digests confirm, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Rules up to this number are sent to every task (a rule is an 8-byte prefix,
#: a digest, a host, a path and a verdict: some hundred bytes).
BROADCAST_RULES = 200_000
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``urls`` with host, path, rule and verdict.

    ``rules`` has host, path and action (allow or block). A rule fits its host
    and all subdomains, if the path starts with the rule's; the longest rule
    (host and path together, then the longer host, then block before allow)
    wins; without one the verdict is ``default``. Rules with a null part are
    skipped, repeated rules count once, repeated rows are judged alike, and a
    null url or one without ``://`` has empty host and path. Columns named like
    the four results are replaced; all others pass unchanged.

    Only distinct (host, path) pairs are expanded and looked up, and verdicts
    come back by an equi-join that adaptive execution can split where a url is
    very common. Rules are broadcast only if there are at most
    ``broadcast_rules``; more are joined on the hash prefix.
    """
    known = rules.select("host", "path", "action").dropna().groupBy("host", "path").agg(F.max("action").alias("action"))
    known = known.withColumn("digest", _digest(F.col("host"), F.col("path")))
    known = known.select(
        F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"),
        "digest",
        F.struct(
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("action") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            "action",
        ).alias("entry"),
    )
    # Distinct lengths only: at most as many as the longest rule has labels or characters.
    sizes = rules.dropna(subset=["host", "path", "action"]).agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")
    ).first()
    host, path = free_name(urls, "__host"), free_name(urls, "__path")
    placed = urls.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})

    parts = F.col("parts")
    pairs = placed.select(F.col(host).alias("h"), F.col(path).alias("p")).filter("h <> ''").distinct()
    suffixes = F.filter(
        F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in sorted(sizes["labels"]))) if sizes["labels"] else F.array().cast("array<string>"),
        lambda s: s.isNotNull(),
    )
    starts = F.filter(
        F.array(*(F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in sorted(sizes["lengths"]))) if sizes["lengths"] else F.array().cast("array<string>"),
        lambda s: s.isNotNull(),
    )
    expressions = (
        pairs.withColumn("parts", F.split("h", r"\."))
        .select("h", "p", F.explode(suffixes).alias("suffix"), starts.alias("starts"))
        .select("h", "p", "suffix", F.explode("starts").alias("start"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("start")))
        .select("h", "p", "digest", F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"))
    )
    few = F.broadcast(known) if sizes["n"] <= broadcast_rules else known
    hits = expressions.alias("x").join(few.alias("k"), (F.col("x.prefix") == F.col("k.prefix")) & (F.col("x.digest") == F.col("k.digest")))
    best = hits.groupBy("h", "p").agg(F.max("entry").alias("entry"))
    found, h, p = free_name(urls, "__entry"), free_name(urls, "__h"), free_name(urls, "__p")
    best = best.select(F.col("h").alias(h), F.col("p").alias(p), F.col("entry").alias(found))
    out = placed.join(best, (F.col(host) == F.col(h)) & (F.col(path) == F.col(p)), "left")
    own = [c for c in urls.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    return out.select(*own, F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{found}.rule").alias("rule"), F.coalesce(f"{found}.action", F.lit(default)).alias("verdict"))
