"""URL filters by hashed host-suffix and path-prefix expressions.

A url is expanded into every expression ``host suffix + path prefix`` that a rule could have; the
first eight hexadecimal digits of an expression's SHA-256 are equi-joined with those of the rules,
the full digests confirm a hit, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged

PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict: one row for each input row.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts
    with its path. The longest rule text wins, then the longer host, then block. A url without a
    fitting rule, also a null one or one without ``://``, gets null and the default verdict.
    Rules with a null host or path never fit. Rows are judged by their url alone, so ids may be
    null or repeated; other columns are not looked at. Empty tables give empty or default results.
    """
    expression = lambda host, path: F.sha2(F.concat(host, F.lit("\x00"), path), 256)
    known = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        expression(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("n_host"), (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")).alias("rule"),
    ).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    # Only label counts and path lengths that some rule has can hit; both are few, being lengths.
    depths = [r[0] for r in rules.filter("host IS NOT NULL").select(F.size(F.split("host", "[.]"))).distinct().collect()]
    lengths = [r[0] for r in rules.filter("path IS NOT NULL").select(F.length("path")).distinct().collect()]

    judged = staged(pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")), "judged-urls")
    urls = judged.select("host", "path").filter("host <> ''").distinct()
    labels = F.split("host", "[.]")
    suffixes = F.filter(F.transform(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))), lambda x: x.isNotNull())
    starts = F.filter(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda x: x.isNotNull())
    expanded = urls.select("host", "path", F.explode(suffixes).alias("suffix"), starts.alias("starts")).select("host", "path", "suffix", F.explode("starts").alias("start"))
    hashed = expanded.select("host", "path", expression(F.col("suffix"), F.col("start")).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    hits = hashed.join(known, "prefix").filter("digest = rule_digest")
    best = hits.groupBy("host", "path").agg(F.max("rule").alias("best"))
    # One url, or none at all, may be that of very many rows.
    joined = spread_join(judged, best, ["host", "path"], "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
