"""Queries of re-scoring. Every document is a candidate of its language's question."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scoring as S
from .base import query, table, values

QUESTIONS = [
    ("en", "What are the rules for a tanker or tug with an all rights reserved note?", ""),
    ("de", "Welche Regeln gelten?", "which rules for a bulk carrier under the apache license"),
    ("fr", "chemical liquefied gas ships and src notes", ""),
    ("es", "pontoon", "anything else"),
]
#: Ship type, target section (here the number of a source), boost.
TYPES = [("tanker", 3, 2.0), ("bulk carrier", 5, 2.0), ("chemical", 7, 2.0), ("liquefied gas", 8, 2.0), ("pontoon", 2, 2.0), ("tug", 9, 2.0)]
PHRASES = [
    ("rights", [r"\brights\s+reserved\b"], [r"\ball\s+rights\b", r"\bcopyright\b"]),
    ("apache", [r"\bapache\b"], [r"\bapache\s+license\b"]),
    ("never", [r"\bno such words\b"], [r"."]),
]

HITS = """hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM (
    SELECT lang AS query_id, doc_id AS id, substr(source, 4)::INTEGER AS section_no, 'Notes of ' || source AS section_title, text AS content, round((n_chars % 97) / 16.0 - 4.0, 6) AS score FROM documents))"""


def hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("query_id"),
        F.col("doc_id").alias("id"),
        F.substring("source", 4, 9).cast("int").alias("section_no"),
        F.concat(F.lit("Notes of "), "source").alias("section_title"),
        F.col("text").alias("content"),
        F.round((F.col("n_chars") % 97) / 16.0 - 4.0, 6).alias("score"),
    )
    return S.placed(docs, "id")


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id string, query string, query_en string")


_RESORT = "(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old))::INTEGER AS pos"


@query(
    "section_boost",
    f"""WITH {HITS}, w(query_id, target) AS (VALUES ('en', 3), ('fr', 8), ('es', 2))
        SELECT query_id, id, section_no, score, {_RESORT} FROM (
          SELECT h.query_id, id, section_no, h.pos AS old, score + CASE WHEN w.target IS NULL THEN 0 ELSE 2.0 END AS score
          FROM hits h LEFT JOIN w ON h.query_id = w.query_id AND h.section_no = w.target)""",
)
def section_boost(spark, sf_dir):
    return S.section_boost(hits(spark, sf_dir), questions(spark), TYPES).select("query_id", "id", "section_no", "score", "pos")


@query(
    "phrase_boost",
    rf"""WITH {HITS} SELECT query_id, id, score, {_RESORT} FROM (
          SELECT query_id, id, pos AS old, score
            + CASE WHEN query_id = 'en' AND regexp_matches(content, '(?i)\ball\s+rights\b|\bcopyright\b') THEN 1.5 ELSE 0 END
            + CASE WHEN query_id = 'de' AND regexp_matches(content, '(?i)\bapache\s+license\b') THEN 1.5 ELSE 0 END AS score FROM hits)""",
)
def phrase_boost(spark, sf_dir):
    return S.phrase_boost(hits(spark, sf_dir), questions(spark), PHRASES).select("query_id", "id", "score", "pos")


#: A question that each shipped rule fires on, and a chunk that it boosts.
_FIRES = [
    ("Cofferdams of an Indonesian-flagged ship?", "ships under Indonesian  flag"), ("tebal tangki sirkulasi", "Circulating tanks have walls"), ("load on a wheel house top", "for wheel house tops"),
    ("celah di bawah pintu", "not more than 12 mm"), ("retak getas pada pelat", "plates over 50 mm"), ("a door, a tank and a flag", "no rule at all"),
]


@query("phrase_rules", f"SELECT p_partkey * 10 + c AS id, CASE WHEN c = p_partkey % {len(_FIRES)} AND c < 5 THEN 1.5::DOUBLE ELSE 0.0 END AS score FROM part, (SELECT unnest(range({len(_FIRES)})) AS c)")
def phrase_rules(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % len(_FIRES))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.get(F.array(*[F.lit(q) for q, _ in _FIRES]), F.col("k")).alias("query"), F.lit(None).cast("string").alias("query_en"))
    chunks = part.select(F.col("p_partkey").alias("query_id"), F.posexplode(F.array(*[F.lit(c) for _, c in _FIRES])).alias("pos", "content"))
    found = S.phrase_boost(chunks.withColumns({"id": F.col("query_id") * 10 + F.col("pos"), "score": F.lit(0.0)}), asked)
    return found.select("id", "score")


@query(
    "table_boost_unique",
    f"""WITH {HITS}, s AS (SELECT *, content LIKE '%MIT License%' AND section_no = 4 AS selected FROM hits),
        n AS (SELECT *, sum(selected::INT) OVER (PARTITION BY query_id) AS n FROM s)
        SELECT query_id, id, score, {_RESORT} FROM (SELECT query_id, id, pos AS old, score + CASE WHEN selected AND n = 1 THEN 3.0 ELSE 0 END AS score FROM n)""",
)
def table_boost_unique(spark, sf_dir):
    marked = hits(spark, sf_dir).withColumn("selected", F.col("content").contains("MIT License") & (F.col("section_no") == 4))
    return S.unique_table_boost(marked).select("query_id", "id", "score", "pos")


_PARTS = "SELECT p_type AS query_id, p_partkey AS id, substr(p_brand, 7)::INTEGER AS section_no, p_name || ' ' || p_size || CASE WHEN p_size % 3 = 0 THEN ' mm' WHEN p_size % 3 = 1 THEN 'kN' ELSE ' pieces' END AS content FROM part"


def parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    unit = F.when(F.col("p_size") % 3 == 0, " mm").when(F.col("p_size") % 3 == 1, "kN").otherwise(" pieces")
    return part.select(
        F.col("p_type").alias("query_id"), F.col("p_partkey").alias("id"), F.substring("p_brand", 7, 9).cast("int").alias("section_no"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), unit).alias("content")
    )


@query(
    "contradictions",
    rf"""SELECT query_id, unit, list_sort(list(DISTINCT section_no)) AS sections FROM (
          SELECT query_id, section_no, unnest(regexp_extract_all(content, '([0-9]+(?:[.,][0-9]+)?)\s*(mm|m|kN|MPa|N/mm2|%|t|kg)\b', 2)) AS unit FROM ({_PARTS}))
        GROUP BY ALL HAVING count(DISTINCT section_no) >= 2""",
)
def contradictions(spark, sf_dir):
    return S.contradictions(parts(spark, sf_dir))


@query(
    "primary_source",
    f"""WITH {HITS}, q(query_id, t) AS (VALUES {values([(q, t) for q, t, _ in QUESTIONS])}),
        s AS (SELECT h.query_id, id, pos, len(list_filter(list_distinct(regexp_split_to_array(lower(section_title), '\\s+')),
                lambda x: NOT list_contains({S.GENERIC!r}, x) AND list_contains(regexp_split_to_array(trim(lower(q.t)), '\\s+'), x)))::INTEGER AS shared FROM hits h JOIN q ON h.query_id = q.query_id)
        SELECT query_id, id, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, pos) AS n FROM s) WHERE n = 1""".replace("\\\\", "\\"),
)
def primary_source(spark, sf_dir):
    return S.primary_source(hits(spark, sf_dir), questions(spark)).select("query_id", "id", "shared")


@query(
    "guardrail",
    f"""WITH {HITS}, t AS (SELECT source AS query_id, max(CASE WHEN p = 1 THEN score END) AS top, max(CASE WHEN p = 2 THEN score END) AS second
          FROM (SELECT d.source, score - 4 + (section_no % 5) / 2.0 AS score, row_number() OVER (PARTITION BY d.source ORDER BY score DESC, id) AS p FROM hits h JOIN documents d ON d.doc_id = h.id) WHERE p <= 2 GROUP BY source)
        SELECT query_id, top, top - coalesce(second, top) AS gap,
          top < -2.0 OR (top - coalesce(second, top) < 0.5 AND top < -1.5) AS rejected,
          CASE WHEN top < -2.0 THEN 'top_below_min' WHEN top - coalesce(second, top) < 0.5 AND top < -1.5 THEN 'flat_distribution' ELSE '' END AS reason FROM t""",
)
def guardrail(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumns({"query_id": F.concat(F.lit("src"), F.col("section_no").cast("string"))})
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).withColumn("score", F.col("score") - 4 + (F.col("section_no") % 5) / 2.0)
    return S.guardrail(rows)


@query(
    "cross_check",
    f"""WITH {HITS}, r(query_id, section_no) AS (VALUES ('en', 3), ('de', 99), ('xx', 1)),
        s AS (SELECT query_id, list(DISTINCT section_no) AS sections FROM hits GROUP BY query_id)
        SELECT r.query_id, r.section_no, CASE WHEN sections IS NULL THEN 'supported' WHEN list_contains(sections, r.section_no) THEN 'confirmed' ELSE 'conflict' END AS status
        FROM r LEFT JOIN s ON r.query_id = s.query_id""",
)
def cross_check(spark, sf_dir):
    rules = spark.createDataFrame([("en", 3), ("de", 99), ("xx", 1)], "query_id string, section_no int")
    return S.cross_check(rules, hits(spark, sf_dir))


@query(
    "lookup_prepend",
    f"""WITH {HITS} SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY pos))::INTEGER AS pos
        FROM (SELECT query_id, id, score, pos FROM hits UNION ALL VALUES ('en', -1, 4.0, 0), ('xx', -1, 2.0, 0))""",
)
def lookup_prepend(spark, sf_dir):
    rules = spark.createDataFrame([("en", -1, 4.0), ("xx", -1, 2.0)], "query_id string, id long, score double")
    return S.prepend(rules, hits(spark, sf_dir)).select("query_id", "id", "score", "pos")


def _cited(df):
    return df.withColumns(
        {
            "paragraph_id": F.when(F.col("id") % 3 == 0, F.concat(F.lit("C."), F.col("section_no").cast("string"))),
            "table_no": F.when(F.col("id") % 4 == 0, "6.1"),
            "figure_no": F.when(F.col("id") % 5 == 0, "2.3"),
            "page_start": (F.col("id") % 200).cast("int"),
            "page_end": (F.col("id") % 200 + F.col("id") % 2).cast("int"),
        }
    )


_CITED = """c AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'C.' || section_no END AS paragraph_id, CASE WHEN id % 4 = 0 THEN '6.1' END AS table_no, CASE WHEN id % 5 = 0 THEN '2.3' END AS figure_no,
  CASE WHEN id % 2 = 0 THEN 'p.' || (id % 200) ELSE 'pp.' || (id % 200) || '-' || (id % 200 + 1) END AS page FROM hits)"""


@query(
    "context_build",
    f"""WITH {HITS}, {_CITED} SELECT query_id, string_agg('[Sec ' || section_no || ' ' || section_title || coalesce(' | ' || paragraph_id, '') || coalesce(' | Table ' || table_no, '')
          || coalesce(' | Fig ' || figure_no, '') || ' | ' || page || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM c WHERE pos <= 8 GROUP BY query_id""",
)
def context_build(spark, sf_dir):
    return S.build_context(_cited(hits(spark, sf_dir)), 8)


@query(
    "citation_format",
    f"""WITH {HITS}, {_CITED}, x AS (SELECT id, '(Sec ' || section_no || CASE WHEN paragraph_id IS NOT NULL THEN ' | ' || paragraph_id || ' ' ELSE ', ' END || page || ')' AS citation, section_title, content FROM c)
        SELECT id, citation, true AS cited, CASE WHEN length(section_title) > 18 THEN left(section_title, 17) || '…' ELSE section_title END AS title,
          CASE WHEN length(trim(replace(content, chr(10), ' '))) > 120 THEN left(trim(replace(content, chr(10), ' ')), 120) || '…' ELSE trim(replace(content, chr(10), ' ')) END AS excerpt FROM x""",
)
def citation_format(spark, sf_dir):
    from ..functions import text as T

    rows = _cited(hits(spark, sf_dir))
    cite = T.citation(F.col("section_no"), F.col("paragraph_id"), F.col("page_start"), F.col("page_end"))
    tagged = F.concat(F.lit("[Sec 1 | x]\n"), "content")
    return rows.select("id", cite.alias("citation"), T.has_citation(cite).alias("cited"), T.short_title(F.col("section_title")).alias("title"), T.excerpt(tagged).alias("excerpt"))
