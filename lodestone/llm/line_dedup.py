"""Operator 1 [native]: site-relative boilerplate line removal.

Pages are grouped by host; a line's frequency is the number of the host's pages that
contain it divided by the host's pages. Lines above ``ratio`` are dropped from every page of that host.
A line must stand on ``min_pages`` pages, two at least: on a host of fewer than 1 / ratio pages any page's own
line is above the ratio. With ``spare_whole`` a page that has no other line keeps its lines, being a
copied page and not the frame around one; this is off unless asked for.

Plan: each page's distinct lines are hashed to 128 bits in place, so what is shuffled
is (host, hash) and never the text. Counts combine before the shuffle and are keyed
by (host, line), so a hot host is spread over its lines. Only the boilerplate hashes
come back, as one list a site. A line of the list stands on more than ``ratio`` of the
site's pages, so the list is shorter than (mean lines a page) / ratio. The lists are
written to the checkpoint folder and measured: up to ``BROADCAST_HASHES`` they are broadcast
and pages never move; beyond, the join is shuffled and the hot site's partition is
split (skew join). A line goes if all 128 bits are in its site's list; the first 64 only
tell which lines need the second hash.

Edge cases: null text counts as empty text (one empty line); blank lines are never
boilerplate and are kept; a null host is a site of its own; repeated rows count as
pages of their own; very long texts and lines are read whole; an empty table gives an empty result; other columns pass
through, and names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RATIO, MIN_PAGES = 0.1, 2
#: Lines (16 bytes each, and as much as 4 of them for a site) up to which the lists are broadcast.
BROADCAST_HASHES = 1_000_000

BREAKS = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|table|nav|article|section|title|head|body|html|footer|header)\b[^>]*>|\n"
TAGS = r"<[^>]*>"


def html_lines(html: Column) -> Column:
    """Visible lines of a page: markup that breaks a line splits, other tags vanish."""
    lines = F.transform(F.split(F.coalesce(html, F.lit("")), BREAKS), lambda x: F.trim(F.regexp_replace(x, TAGS, "")))
    return F.filter(lines, lambda x: x != "")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def drop_boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, spare_whole: bool = False) -> DataFrame:
    """All rows of ``pages`` plus __lines (all lines) and __kept (the lines that stay)."""
    site = F.coalesce(F.concat(F.lit("="), host), F.lit(""))
    base = pages.withColumns({"__site": site, "__lines": lines})
    key = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))
    own = base.select("__site", F.array_distinct(F.transform(F.filter("__lines", lambda x: F.trim(x) != ""), key)).alias("keys"))
    totals = own.groupBy("__site").agg(F.count(F.lit(1)).alias("total"))
    boiler = (
        own.select("__site", F.explode("keys").alias("key"))
        .groupBy("__site", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= max(2, min_pages))
        .join(totals, "__site")
        .where(F.col("n") > F.col("total") * F.lit(float(ratio)))
    )
    # A site has fewer such lines than its mean number of lines a page, over the ratio.
    per_site = cut(boiler.groupBy("__site").agg(F.collect_list("key").alias("__drop")))
    listed = per_site.agg(F.sum(F.size("__drop") + 4)).first()[0] or 0
    per_site = per_site.select("__site", "__drop", F.col("__drop.a").alias("__first"))
    joined = base.join(F.broadcast(per_site) if listed <= BROADCAST_HASHES else per_site, "__site", "left")
    hashes = F.transform("__lines", lambda x: F.xxhash64(x))
    joined = joined.withColumn("__hit", F.array_intersect(F.coalesce("__first", F.array().cast("array<bigint>")), hashes))
    stays = lambda x: ~F.array_contains("__hit", F.xxhash64(x)) | (F.trim(x) == "") | ~F.array_contains("__drop", key(x))
    kept = F.when(F.size("__hit") == 0, F.col("__lines")).otherwise(F.filter("__lines", stays))
    if spare_whole:
        kept = F.when(F.exists(kept, lambda x: F.trim(x) != ""), kept).otherwise(F.col("__lines"))
    return joined.withColumn("__kept", kept).drop("__site", "__drop", "__first", "__hit")
