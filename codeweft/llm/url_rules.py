"""URL filters by hashed host-suffix and path-prefix expressions.

A URL expands into every suffix of its host (at label boundaries) followed by every prefix of its path that has the length of some
rule's path. Expressions meet rules in an equi-join on the first four bytes of their SHA-256; the whole digest confirms a
match, and the longest confirmed rule decides (of equal lengths the longer host, then a blocking rule, then the smaller text).

Expansion stays in its row until the join, and the rules are broadcast only if they measure small; the aggregation back to URLs
combines inside the task before it shuffles one row per URL. Only DataFrame functions are used.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; urls that fit no rule get
``default``; repeated rows each get a row; rules with null parts are skipped; columns of ``urls`` named like the four added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.words import ascii_lower, kept_names
from codeweft.session import broadcast_if_small

_PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``urls`` with ``url_host, url_path, url_rule, url_verdict``.

    ``rules(host, path, verdict)``: a rule fits its host and all hosts below it, where the url's path starts with its path.
    """
    columns = kept_names(urls, "url_host", "url_path", "url_rule", "url_verdict")
    rules = rules.filter("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct()
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().toLocalIterator())
    listed = rules.select(
        F.sha2(F.concat("host", "path").cast("binary"), 256).alias("digest"),
        F.struct(
            F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"),
        ).alias("found"),
    )
    listed = listed.select(F.substring("digest", 1, 8).alias("short"), "digest", "found")
    rows = urls.select(F.struct(*[urls[c] for c in columns]).alias("row"), host_of(urls[url_col]).alias("host"), path_of(urls[url_col]).alias("path"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = rows.select("at", "row", "host", "path", F.explode_outer(F.array_distinct(expressions)).alias("expression"))
    expanded = expanded.withColumn("digest", F.sha2(F.col("expression").cast("binary"), 256)).withColumn("short", F.substring("digest", 1, 8))
    matched = expanded.join(broadcast_if_small(listed).withColumnRenamed("digest", "whole"), "short", "left")
    found = F.when(F.col("digest") == F.col("whole"), F.col("found"))
    judged = matched.groupBy("at").agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(found).alias("found"))
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in columns], F.col("host").alias("url_host"), F.col("path").alias("url_path"),
        F.col("found.rule").alias("url_rule"), F.coalesce("found.verdict", F.lit(default)).alias("url_verdict"),
    )
