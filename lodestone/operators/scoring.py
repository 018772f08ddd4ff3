"""Re-scoring of retrieved chunks: boosts, cross-checks, contradictions, guardrail, context.

Rows are (query_id, pos, id, section_no, section_title, content, score, ...); ``pos`` is the order
left by the last sort, which several steps read. A sort is stable: ties keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_range

# Ship type, its section and its boost.
SHIP_TYPES = [
    ("container ship", 39, 2.0), ("bulk carrier", 23, 2.0), ("ore carrier", 23, 2.0), ("tanker", 24, 2.0), ("passenger ship", 29, 2.0),
    ("tug", 27, 2.0), ("fishing vessel", 28, 2.0), ("dredger", 32, 2.0), ("barge", 31, 2.0), ("pontoon", 31, 2.0), ("supply vessel", 34, 2.0),
    ("chemical", 25, 2.0), ("liquefied gas", 26, 2.0), ("floating dock", 33, 2.0),
]


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The longest keyword (first of equals) that the text holds as a substring; else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in sorted(keywords, key=len, reverse=True)])


def placed(hits: DataFrame, ties: str) -> DataFrame:
    """``pos`` of each row among those of its query by score, ties by the column.

    A query may have any number of hits: rows are dealt by (query, score), and their places start behind the counted rows of higher scores.
    """
    key = F.struct("query_id", "score").alias("__k")  # equal where both are null
    counted = hits.groupBy("query_id", "score").agg(F.count(F.lit(1)).alias("n"))
    higher = Window.partitionBy("query_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(key, F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__k").orderBy(ties)
    return hits.select("*", key).join(starts, "__k").withColumn("pos", (F.row_number().over(own) + F.col("__start")).cast("int")).drop("__k", "__start")


def resorted(hits: DataFrame) -> DataFrame:
    """New ``pos`` by score, ties in the order they had."""
    return placed(hits, "pos")


def section_boost(hits: DataFrame, queries: DataFrame, types=SHIP_TYPES) -> DataFrame:
    """Adds a boost to chunks of the section that the query's ship type names; never lowers."""
    spark = hits.sparkSession
    small = spark.createDataFrame(types, "ship_type string, target int, boost double")
    asked = queries.select("query_id", first_keyword(F.col("query"), [t[0] for t in types]).alias("ship_type"))
    wanted = asked.join(F.broadcast(small), "ship_type").select("query_id", F.col("target").alias("section_no"), "ship_type", "boost")
    boosted = hits.join(wanted, ["query_id", "section_no"], "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0)))
    return resorted(boosted.drop("ship_type", "boost"))


# Name, patterns of a question, patterns of a chunk.
PHRASE_RULES = [
    ("indonesian_flag_cofferdam", [r"\bindonesian\s*[- ]?flag(?:ged)?\b", r"\bberbendera\s+indonesia\b", r"\bbendera\s+indonesia\b"], [r"\bindonesian\s+flag\b", r"\bbendera\s+indonesia\b"]),
    ("circulating_tank_shell", [r"\bcirculating\s+tanks?\b", r"\btangki\s+sirkulasi\b"], [r"\bcirculating\s+tanks\b", r"\b500\s*mm\b"]),
    ("wheel_house_top_load", [r"\bwheel\s+house\s+tops?\b", r"\batap\s+ruang\s+kemudi\b"], [r"\bwheel\s+house\s+tops\b"]),
    ("fire_door_gap", [r"\bgap\b.{0,25}\bdoor\b", r"\bdoor\b.{0,25}\bgap\b", r"\bcelah\b.{0,25}\bpintu\b", r"\bpintu\b.{0,25}\bcelah\b"], [r"\bgap\s+under\s+the\s+door\b", r"\b12\s*mm\b"]),
    (
        "brittle_crack_thick_plates",
        [r"\bbrittle\s+crack\b", r"\bretak\s+getas\b", r"\bextremely\s+thick\b", r"\bsangat\s+tebal\b"],
        [r"\bbrittle\s+crack\b", r"\bextremely\s+thick\b", r"\bover\s+50\s*mm\b", r"\b50\s*mm\b.*\b100\s*mm\b"],
    ),
]


def phrase_boost(hits: DataFrame, queries: DataFrame, rules: list[tuple[str, list[str], list[str]]] = PHRASE_RULES, weight: float = 1.5) -> DataFrame:
    """Each rule whose query pattern fits adds ``weight`` once to chunks that its content pattern fits."""
    either = lambda patterns: "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    text = F.concat_ws(" ", F.coalesce("query", F.lit("")), F.coalesce("query_en", F.lit("")))
    active = queries.select("query_id", F.filter(F.array(*[F.when(text.rlike(either(q)), F.lit(n)) for n, q, _ in rules]), lambda x: x.isNotNull()).alias("active"))
    joined = hits.join(active, "query_id", "left")
    added = F.lit(0.0)
    for name, _, content in rules:
        added = added + F.when(F.array_contains("active", name) & F.col("content").rlike(either(content)), F.lit(float(weight))).otherwise(F.lit(0.0))
    return resorted(joined.withColumn("score", F.col("score") + added).drop("active"))


def unique_table_boost(hits: DataFrame, boost: float = 3.0) -> DataFrame:
    """If exactly one of a query's table candidates selected a row (``selected``), boosts it."""
    only = hits.where("selected").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n = 1")
    one = only.select(F.struct("query_id", "id").alias("__one"), F.lit(True).alias("__alone"))
    marked = hits.withColumn("__one", F.struct("query_id", "id")).join(one, "__one", "left")
    return resorted(marked.withColumn("score", F.col("score") + F.when(F.col("selected") & F.col("__alone"), F.lit(float(boost))).otherwise(F.lit(0.0))).drop("__one", "__alone"))


def cross_check(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """rules (query_id, section_no) -> status: confirmed, supported (no hits) or conflict."""
    seen = hits.groupBy("query_id").agg(F.collect_set("section_no").alias("sections"))
    status = F.when(F.col("sections").isNull(), "supported").when(F.array_contains("sections", F.col("section_no")), "confirmed").otherwise("conflict")
    return rules.join(seen, "query_id", "left").withColumn("status", status).drop("sections")


def prepend(lookup_rows: DataFrame, hits: DataFrame) -> DataFrame:
    """A matched rule as a synthetic first chunk; the others move down."""
    first = lookup_rows.withColumn("pos", F.lit(0))
    window = Window.partitionBy("query_id").orderBy("pos")
    return first.unionByName(hits, allowMissingColumns=True).withColumn("pos", F.row_number().over(window))


#: Fixed value: a number and its unit.
VALUE_UNIT = r"([0-9]+(?:[.,][0-9]+)?)\s*(mm|m|kN|MPa|N/mm2|%|t|kg)\b"


def contradictions(hits: DataFrame) -> DataFrame:
    """(query_id, unit, sections): units with values in two or more sections."""
    units = hits.select("query_id", "section_no", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(VALUE_UNIT), F.lit(2)))).alias("unit"))
    return units.groupBy("query_id", "unit").agg(F.sort_array(F.collect_set("section_no")).alias("sections")).where(F.size("sections") >= 2)


# Words that say nothing about a section's topic.
GENERIC = "the a an and or of for with in on to is are what how minimum maximum ships ship vessel vessels structures plate plating rules".split()


def overlap(title: Column, query: Column, ignored: list[str] = GENERIC) -> Column:
    split = lambda c: F.array_except(F.array_distinct(F.split(F.trim(F.lower(c)), r"\s+")), F.array(*[F.lit(x) for x in ignored]))
    return F.size(F.array_intersect(split(title), split(query)))


def primary_source(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The chunk whose section title shares most words with the query; the first of equals."""
    scored = hits.join(queries.select("query_id", "query"), "query_id").withColumn("shared", overlap(F.col("section_title"), F.col("query")))
    window = Window.partitionBy("query_id").orderBy(F.desc("shared"), "pos")
    return scored.withColumn("n", F.row_number().over(window)).where("n = 1").drop("n", "query")


MIN_TOP, TOP_GAP = -2.0, 0.5


def guardrail(hits: DataFrame, min_top: float = MIN_TOP, top_gap: float = TOP_GAP) -> DataFrame:
    """One row a query: rejected and why, from the first two scores as ordered."""
    top = hits.where(F.col("pos") <= 2).groupBy("query_id").agg(F.max(F.when(F.col("pos") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("pos") == 2, F.col("score"))).alias("second"))
    gap = F.col("top") - F.coalesce("second", "top")
    low, flat = F.col("top") < min_top, (gap < top_gap) & (F.col("top") < min_top + 0.5)
    reason = F.when(low, "top_below_min").when(flat, "flat_distribution").otherwise("")
    return top.select("query_id", "top", gap.alias("gap"), (low | flat).alias("rejected"), reason.alias("reason"))


def context_blocks(hits: DataFrame) -> Column:
    """Tag line and content of a chunk."""
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(" | " + label), F.col(c))).otherwise("")
    return F.concat(
        F.lit("[Sec "), F.col("section_no").cast("string"), F.lit(" "), F.col("section_title"), part("", "paragraph_id"), part("Table ", "table_no"), part("Fig ", "figure_no"),
        F.lit(" | "), page_range(F.col("page_start"), F.col("page_end")), F.lit("]\n"), F.col("content"),
    )


def build_context(hits: DataFrame, keep: int) -> DataFrame:
    """(query_id, context) of the first ``keep`` chunks of each query, in order."""
    blocks = hits.where(F.col("pos") <= keep).select("query_id", "pos", context_blocks(hits).alias("block"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"])
    return blocks.groupBy("query_id").agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))
