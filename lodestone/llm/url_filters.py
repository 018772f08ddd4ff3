"""Operator 4 [native]: URL allow/block rules by hashed host-suffix / path-prefix expressions.

Every URL is expanded into (host suffix + path prefix) expressions. Rules are
stored under a 32-bit prefix of the expression's SHA-256; the equi-join is on that
short prefix, the full digest confirms, and the longest rule wins.

The verdict depends only on the host and on the first ``max rule path`` characters
of the path, so expressions are made once per distinct (host, path head) and not
once per row: a hot host or page is one row there. Only suffixes of as many labels, and prefixes of as many
characters, as some rule has are made, so a host of very many labels costs no more than
its length. The judged pairs are written to the checkpoint folder and
counted: up to ``BROADCAST_ROWS`` they are broadcast and pages never move; beyond, the join
is shuffled and skewed keys are split.

Edge cases: a null url or one without ``://`` has an empty host and path and matches
nothing; an empty host label or port is kept as written; hosts of any number of labels and very long urls are read whole; equal-length rules that both
fit the same url (only possible by repeating a rule with the other verdict): block
wins; null or empty rule hosts fit nothing; empty tables give an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Judged (host, path head) pairs up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000

HOST = r"^(?s:.*?)://([^/?#]*)"
PATH = r"^(?s:.*?)://[^/?#]*([^?#]*)"


def host_and_path(url):
    """Columns (host, path) of a url column."""
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, HOST, 1)), F.regexp_extract(text, PATH, 1)


def _short(expression):
    return F.conv(F.substring(F.sha2(expression, 256), 1, 8), 16, 10).cast("long")


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> one row per expression: short hash, digest, rule, verdict."""
    host = ascii_lower(F.col("host"))
    path = F.coalesce(F.col("path"), F.lit(""))
    return (
        rules.where((F.length("host") > 0) & F.col("verdict").isin("allow", "block"))
        .select(F.concat(host, path).alias("rule"), F.concat_ws("\n", host, path).alias("expression"), F.length(path).alias("path_len"), F.size(F.split(host, "[.]")).alias("labels"), "verdict")
        .groupBy("rule", "expression", "path_len", "labels")
        .agg(F.max("verdict").alias("rule_verdict"))  # 'block' > 'allow'
        .select("rule", "rule_verdict", "path_len", "labels", _short("expression").alias("short"), F.sha2("expression", 256).alias("digest"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (url, ...) -> all its rows with host, path, rule and verdict."""
    host, path = host_and_path(F.col("url"))
    ruled = prepare_rules(rules)
    # two short lists: the distinct lengths of the rules' paths and numbers of the labels of their hosts
    sizes = ruled.agg(F.collect_set("path_len"), F.collect_set("labels")).first()
    lengths, labels = sorted(sizes[0]) or [0], sorted(sizes[1]) or [1]
    drop = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns]
    parts = pages.withColumns({"__host": host, "__path": path}).drop(*drop)
    parts = parts.withColumn("__head", F.substring("__path", 1, lengths[-1]))

    keys = parts.select("__host", "__head").where("__host <> ''").distinct()
    expanded = keys.select(
        "__host",
        "__head",
        F.explode(
            F.expr(
                f"""flatten(transform(filter(array({", ".join(map(str, labels))}), k -> k <= size(split(__host, '[.]'))), k ->
                     transform(filter(array({", ".join(map(str, lengths))}), n -> n <= length(__head)), n ->
                       concat(substring_index(__host, '.', -k), '\\n', substring(__head, 1, n)))))"""
            )
        ).alias("expression"),
    ).withColumn("short", _short("expression"))
    hits = (
        expanded.join(ruled, "short")
        .where(F.sha2("expression", 256) == F.col("digest"))
        .groupBy("__host", "__head")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule_verdict"), F.col("rule"))).alias("best"))
        .select(F.col("__host").alias("__hit_host"), F.col("__head").alias("__hit_head"), F.col("best.rule").alias("__rule"), F.col("best.rule_verdict").alias("__verdict"))
    )
    hits = cut(hits)
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    joined = parts.join(hits, (F.col("__host") == F.col("__hit_host")) & (F.col("__head") == F.col("__hit_head")), "left")
    told = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule"), "verdict": F.coalesce("__verdict", F.lit(default))}
    return joined.withColumns(told).drop("__host", "__path", "__head", "__hit_host", "__hit_head", "__rule", "__verdict")
