"""URL filters: host-suffix / path-prefix expressions joined on hash prefixes.

Each distinct URL is expanded into every (host suffix, path prefix) expression
that some rule could name, the short prefixes of the expressions' SHA-256 are
equi-joined with those of the rules, and a hit counts only when the full digest
agrees and the URL's path starts with the rule's path.  The most specific rule
decides; a URL that no rule fits gets the default verdict.

Shape: the expansion is bounded by the rules (no more labels than the longest
rule host has, no more segments than the deepest rule path), a URL that many
pages share is expanded once, and the verdicts are joined back to the pages by
URL with both sides exchanged, so that AQE can split a hot URL.  No Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

RULE_SCHEMA = "action string, host string, path string"
HASH_PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end; '' if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    """The part of a path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)\A(.*/)", 1)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules(action, host, path) → one row per (host, path) with its digests.

    Rules without a host or action are void; a null path is ''.  When the same
    (host, path) is both allowed and blocked, block wins.
    """
    r = rules.where("host is not null and host != '' and action is not null").select(
        "action", lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    r = r.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    digest = _digest(F.col("rule_host"), _folder(F.col("rule_path")))
    return r.select("*", digest.alias("rule_digest"), F.substring(digest, 1, HASH_PREFIX_DIGITS).alias("prefix"))


def expand(urls: DataFrame, max_labels: int, max_slashes: int) -> DataFrame:
    """urls(url, host, path) → (url, path, digest, prefix), one row per expression.

    Host suffixes of up to ``max_labels`` labels × path folders of up to
    ``max_slashes`` slashes (the empty folder included).  No rule is longer, so
    the bounds lose nothing, however long the URL is.
    """
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.lit(max_labels), F.size(labels))),
                        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    segments = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.least(F.lit(max_slashes), F.size(segments) - 1)),
                          lambda n: F.when(n == 0, F.lit("")).otherwise(
                              F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), n), F.lit("/"))))
    by_host = urls.select("url", "path", F.explode(F.array_distinct(hosts)).alias("suffix"), folders.alias("folders"))
    pairs = by_host.select("url", "path", "suffix", F.explode("folders").alias("folder"))
    digest = _digest(F.col("suffix"), F.col("folder"))
    return pairs.select("url", "path", digest.alias("digest")).select(
        "*", F.substring("digest", 1, HASH_PREFIX_DIGITS).alias("prefix"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages + host, path, rule, verdict.

    A rule fits its host and all its subdomains when the URL's path starts with
    the rule's path.  The longest rule (host and path together) wins; at equal
    length the longer host, then the larger text.

    Defined results: a null URL or one without ``://`` has empty host and path,
    no rule and the default verdict; an empty rule table gives every page the
    default; an empty page table gives no rows; repeated pages are judged each;
    the columns host, path, rule and verdict replace any of the same name, other
    columns pass through.
    """
    out = ["host", "path", "rule", "verdict"]
    base = pages.select(*[c for c in pages.columns if c.lower() not in out],
                        url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    prepared = prepare_rules(rules)
    # Two numbers that describe the rule table.
    size = prepared.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("rule_path", "/")) - 1).alias("slashes")).first()
    if size.labels is None:
        return base.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))

    urls = base.where(F.col("host") != "").select(F.col(url_col).alias("url"), "host", "path").distinct()
    hits = expand(urls, size.labels, size.slashes).join(prepared, "prefix").where(
        (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = hits.groupBy("url").agg(F.max(F.struct(
        F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), "action")).alias("best"))
    best = materialize(best.select(F.col("url").alias("__rule_url"), F.col("best.rule").alias("rule"),
                                   F.col("best.action").alias("verdict")), "url-verdicts")
    # Verdicts grow with the pages, so they are never broadcast; AQE splits a hot URL's partition.
    joined = base.join(best.hint("merge"), F.col(url_col) == F.col("__rule_url"), "left")
    return joined.select(*base.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
