"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL becomes the list of all (host suffix, path prefix) expressions that a
rule could be written as. The expressions meet the rules in an equi-join on the
first four bytes of their SHA-256; the full digests confirm a match, and the
longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (action, host, path prefix)
Rule = tuple[str, str, str]
#: At most so many rules are broadcast (some 20 MB); more are joined by a shuffle.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict, n_expressions.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. Of several the longest wins (host and path together, then the longer
    host, then the action ``block``); with none, rule is null and the verdict is
    ``default``. Null URLs and URLs without ``://`` have an empty host and path
    and get the default. Repeated rows and null keys stay, each with its own
    row; an empty table gives an empty result. Only the two named columns are
    read, so other columns can't clash. rules: a list, or a table (action, host,
    path) of any size; rules with a null count for nothing.
    """
    spark = pages.sparkSession
    names = ["action", "rule_host", "rule_path"]
    table = rules.select(*[F.col(x).alias(y) for x, y in zip(("action", "host", "path"), names, strict=True)]) if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), ", ".join(f"{c} string" for c in names))
    table = table.dropna().distinct()
    # Lengths of paths: a few numbers, however many rules there are.
    found = table.groupBy(F.length("rule_path").alias("n")).count().collect()
    lengths, small = sorted(r["n"] for r in found), sum(r["count"] for r in found) <= BROADCAST_RULES
    table = table.select("action", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_length"), F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("digest")).withColumn("short", _short(F.col("digest")))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    each = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    each = each.withColumn("digests", F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat_ws("\n", h, p), 256)))))
    each = each.select("row", "id", "host", "path", F.size("digests").alias("n_expressions"), F.explode_outer("digests").alias("full")).withColumn("short", _short(F.col("full")))
    found = each.join(F.broadcast(table) if small else table.hint("merge"), "short", "left")
    hit = F.when(F.col("full") == F.col("digest"), F.struct(F.length("rule").alias("length"), "host_length", "action", "rule"))
    best = found.groupBy("row", "id", "host", "path", "n_expressions").agg(F.max(hit).alias("best"))
    return best.select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), "n_expressions")
