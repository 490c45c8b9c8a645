"""URL filters by hashed expressions, with DataFrame operations only.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with
the rule's path.  Each URL is expanded into expressions "host suffix + path prefix", of the shapes
(labels in the host, characters in the path) that rules have; an expression longer than any rule
could not match.  Expressions are equi-joined with the rules on the first 8 hex digits of their
SHA-256, confirmed by the whole digest, and the longest rule wins (then block, then the smaller
rule text).  Without a rule the verdict is ``default``.

The expansion is a projection over the pages.  Whether the rules are broadcast is left to Spark's
size check; past it the join shuffles 80-byte expression rows, and adaptive execution splits an
expression that many URLs share.  Only the shapes of the rules (pairs of small integers) come to
the driver.

Defined cases: a null URL or one without "://" has empty host and path and matches no rule; ports
and user names count as part of the host; repeated rows are judged one by one; rules with a null
or empty host, null verdict or null path ("" stands for any path) are left out or read as "any";
equal rules with different verdicts block; an empty table gives no rows; only page_id and url are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8     # hex digits joined on

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def digests(rules: DataFrame) -> DataFrame:
    """Rules as (prefix, digest, labels, chars, rule, block)."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    digest = F.sha2(F.concat(host, path), 256)
    return (rules.where("host is not null and host <> '' and verdict in ('allow', 'block')")
            .select(F.substring(digest, 1, PREFIX).alias("prefix"), digest.alias("digest"),
                    F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("chars"),
                    F.concat(host, path).alias("rule"), (F.col("verdict") == "block").alias("block"))
            .groupBy("prefix", "digest", "labels", "chars", "rule").agg(F.max("block").alias("block")))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = digests(rules)
    shapes = [(r.labels, r.chars) for r in rules.select("labels", "chars").distinct().collect()]
    if not shapes:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    have = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in sorted(shapes)])
    labels = F.split("host", r"\.")
    fitting = F.filter(have, lambda s: (s["labels"] <= F.size(labels)) & (s["chars"] <= F.length("path")))
    expressions = F.transform(fitting, lambda s: F.sha2(F.concat(
        F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."),
        F.substring(F.col("path"), F.lit(1), s["chars"])), 256))
    each = (urls.where("host <> ''").select("page_id", "host", "path", F.explode(expressions).alias("digest"))
            .withColumn("prefix", F.substring("digest", 1, PREFIX)))
    found = each.alias("e").join(rules.alias("r"), "prefix").where("e.digest = r.digest")
    best = (found.groupBy("page_id", "host", "path")
            .agg(F.min(F.struct(-(F.length("rule")), ~F.col("block"), "rule")).alias("b"))
            .select(*[F.col(c).alias(f"_{c}") for c in ("page_id", "host", "path")],
                    F.col("b.rule").alias("rule"), (~F.col("b.col2")).alias("block")))
    same = (urls["page_id"].eqNullSafe(best["_page_id"]) & (urls["host"] == best["_host"])
            & (urls["path"] == best["_path"]))
    verdict = F.when(F.col("block"), "block").when(~F.col("block"), "allow").otherwise(default)
    return urls.join(best, same, "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
