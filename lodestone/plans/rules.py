"""Queries of the rule matcher. Every part's name and type is a question; the rules are a small table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as O
from ..functions.text import term_matches, normalise
from .base import query, table, values

#: rule_id, topic, parameter, value text, trigger terms
RULES = [
    (1, "steel_strength", "steel", "206000 N/mm2", ["steel", "strength", "anodized"]),
    (2, "steel_strength", "brass", "105000 N/mm2", ["brass", "strength", "anodized"]),
    (3, "copper_use", None, "only when polished", ["copper", "polished", "large"]),
    (4, "small_parts", None, "10 mm", ["small", "plated", "parts"]),
    (5, "economy", None, "see there", ["economy", "burnished", "EC", "PART"]),
    (6, "plain", None, "none", ["part", "standard"]),
]
CONTEXT = [("copper_use", "copper"), ("copper_use", "polished")]
ANCHORS = [("small_parts", "small"), ("economy", "burnished"), ("economy", "economy anodized")]
EXCLUDES = [("plain", "tin"), ("economy", "nickel")]
TOKENS = [("steel_strength", "steel", "steel"), ("steel_strength", "brass", "brass"), ("copper_use", "x", "large"), ("copper_use", "y", "medium")]
ASPECTS = [("size", "small"), ("size", "large"), ("finish", "plated"), ("finish", "polished"), ("metal", "steel"), ("metal", "copper")]
EXPECTED = [("copper_use", ["finish"]), ("small_parts", ["finish", "metal"])]
EXCLUDED = [("small_parts", ["metal"])]


def tables(spark):
    rules = spark.createDataFrame([(*r, i) for i, r in enumerate(RULES)], "rule_id int, topic string, parameter string, value_text string, trigger_terms array<string>, rule_pos int")
    pair = lambda rows: spark.createDataFrame(rows, "topic string, term string")
    tokens = spark.createDataFrame(TOKENS, "topic string, parameter string, term string")
    return rules, O.Gates(pair(CONTEXT), pair(ANCHORS), pair(EXCLUDES), tokens, {"steel_strength": "steel"})


def questions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_type", "p_name").alias("query"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("standard strength parts").alias("query_en"))


_NORM = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_Q = f"""q AS (SELECT p_partkey AS query_id, ' ' || {_NORM("p_type || ' ' || p_name || ' ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'standard strength parts' END")} || ' ' AS t, ' ' || {_NORM("p_type || ' ' || p_name")} || ' ' AS o FROM part)"""


def _hit(text: str, term: str) -> str:
    """Whole word for short or all-capital terms, else substring."""
    return f"contains({text}, CASE WHEN NOT contains({term}, ' ') AND (length({term}) <= 2 OR regexp_matches({term}, '^[A-Z]+$')) THEN ' ' || lower({term}) || ' ' ELSE lower({term}) END)"


_TRIGGERS = [(r[0], r[1], r[2], i, t) for r in RULES for i, t in enumerate(r[4])]
_BASE = f"""{_Q},
  g(rule_id, topic, parameter, i, term) AS (VALUES {values(_TRIGGERS)}),
  k(topic, parameter, term) AS (VALUES {values(TOKENS)}), r(rule_id, topic, parameter) AS (VALUES {values([r[:3] for r in RULES])}),
  b AS (SELECT query_id, rule_id, count(*) AS base, list(term ORDER BY i) AS matched FROM q JOIN g ON {_hit("t", "term")} GROUP BY ALL),
  p AS (SELECT query_id, rule_id, 2 * count(*) AS bonus FROM q JOIN (SELECT r.rule_id, k.term FROM r JOIN k ON r.topic = k.topic AND (r.parameter IS NULL OR r.parameter = k.parameter)) ON {_hit("t", "term")} GROUP BY ALL),
  s AS (SELECT q.query_id, r.rule_id, r.topic, r.parameter, q.t, q.o, coalesce(base, 0) AS base, coalesce(bonus, 0) AS bonus, coalesce(base, 0) + coalesce(bonus, 0) AS total, coalesce(matched, []) AS matched
        FROM q JOIN r ON true LEFT JOIN b ON b.query_id = q.query_id AND b.rule_id = r.rule_id LEFT JOIN p ON p.query_id = q.query_id AND p.rule_id = r.rule_id),
  x(topic, term) AS (VALUES {values(CONTEXT)}), a(topic, term) AS (VALUES {values(ANCHORS)}), e(topic, term) AS (VALUES {values(EXCLUDES)}),
  c AS (SELECT * FROM s WHERE total >= 2
    AND (topic NOT IN (SELECT topic FROM x) OR EXISTS (SELECT 1 FROM x WHERE x.topic = s.topic AND {_hit("s.o", "x.term")}))
    AND (topic NOT IN (SELECT topic FROM a) OR EXISTS (SELECT 1 FROM a WHERE a.topic = s.topic AND {_hit("s.t", "a.term")}))
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.topic = s.topic AND {_hit("s.t", "e.term")})),
  w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, rule_id) AS n, max(total) OVER (PARTITION BY query_id) AS best, sum(bonus) OVER (PARTITION BY query_id) AS bonuses FROM c),
  y AS (SELECT *, sum((total = best)::INT) OVER (PARTITION BY query_id) > 1 AS tied, max(CASE WHEN n = 1 THEN topic END) OVER (PARTITION BY query_id) AS first_topic,
        row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN parameter = 'steel' THEN 0 ELSE 1 END, coalesce(parameter, ''), rule_id) AS f FROM w)"""
_CHOSEN = "CASE WHEN tied THEN first_topic = 'steel_strength' AND bonuses = 0 AND f = 1 ELSE n = 1 AND NOT (topic IN (SELECT topic FROM k) AND bonus = 0 AND parameter IS NOT NULL) END"


@query("lookup_match", f"WITH {_BASE} SELECT query_id, rule_id, topic, parameter, matched, base, bonus, total FROM y WHERE {_CHOSEN}")
def lookup_match(spark, sf_dir):
    rules, gates = tables(spark)
    out = O.match_rules(questions(spark, sf_dir), rules, gates)
    return out.select("query_id", "rule_id", "topic", "parameter", "matched", *[F.col(c).cast("long").alias(c) for c in ("base", "bonus", "total")])


@query(
    "lookup_gates",
    f"""WITH {_Q}, x(topic, term) AS (VALUES {values(CONTEXT)}), a(topic, term) AS (VALUES {values(ANCHORS)}), e(topic, term) AS (VALUES {values(EXCLUDES)})
        SELECT 'context' AS gate, query_id, topic, count(*) AS n FROM q JOIN x ON {_hit("o", "term")} GROUP BY ALL
        UNION ALL SELECT 'anchor', query_id, topic, count(*) FROM q JOIN a ON {_hit("t", "term")} GROUP BY ALL
        UNION ALL SELECT 'exclude', query_id, topic, count(*) FROM q JOIN e ON {_hit("t", "term")} GROUP BY ALL""",
)
def lookup_gates(spark, sf_dir):
    _, gates = tables(spark)
    text = O.texts(questions(spark, sf_dir))
    part = lambda name, gate, column: O.hits(text, gate, column, ["topic"]).groupBy("query_id", "topic").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("gate"), "query_id", "topic", "n")
    return part("context", gates.context, "original").unionByName(part("anchor", gates.anchors, "combined")).unionByName(part("exclude", gates.excludes, "combined"))


_ASPECT = f"z(aspect, term) AS (VALUES {values(ASPECTS)}), d AS (SELECT query_id, list_sort(list(DISTINCT aspect)) AS aspects FROM q JOIN z ON {_hit('t', 'term')} GROUP BY query_id)"


@query("lookup_aspects", f"WITH {_Q}, {_ASPECT} SELECT * FROM d")
def lookup_aspects(spark, sf_dir):
    return O.aspects(questions(spark, sf_dir), spark.createDataFrame(ASPECTS, "aspect string, term string"))


@query(
    "lookup_precision",
    f"""WITH {_BASE}, {_ASPECT}, m AS (SELECT y.query_id, topic, coalesce(aspects, []) AS aspects FROM y LEFT JOIN d ON d.query_id = y.query_id WHERE {_CHOSEN})
        SELECT query_id, topic, reason, reason = 'ok' AS ok FROM (SELECT *, CASE
          WHEN topic = 'small_parts' AND list_contains(aspects, 'metal') THEN 'excluded_aspect:metal'
          WHEN topic = 'small_parts' AND NOT list_has_any(aspects, ['finish', 'metal']) THEN 'missing_aspect:finish,metal'
          WHEN topic = 'copper_use' AND NOT list_contains(aspects, 'finish') THEN 'missing_aspect:finish' ELSE 'ok' END AS reason FROM m)""",
)
def lookup_precision(spark, sf_dir):
    rules, gates = tables(spark)
    asked = questions(spark, sf_dir)
    lists = lambda rows: spark.createDataFrame(rows, "topic string, aspects array<string>")
    found = O.precision(O.match_rules(asked, rules, gates), asked, spark.createDataFrame(ASPECTS, "aspect string, term string"), lists(EXPECTED), lists(EXCLUDED))
    return found.select("query_id", "topic", "reason", "ok")


@query(
    "lookup_required_context",
    """SELECT p_partkey AS query_id, CASE WHEN p_size % 4 = 1 THEN 'ok' ELSE 'missing_required_context:dredger_bottom_transverse_spacing_aground' END AS reason FROM (SELECT * FROM part WHERE p_partkey % 3 < 2)
       UNION ALL SELECT p_partkey, 'ok' FROM part WHERE p_partkey % 3 = 2""",
)
def lookup_required_context(spark, sf_dir):
    """A dredger's rule with the term in the original, in the English text only, or with a blank original; and a topic without such terms."""
    size = F.col("p_size") % 4
    part = table(spark, sf_dir, "part").withColumn("query_id", F.col("p_partkey"))
    asked = part.select("query_id", F.when(size == 0, " ").when(size == 1, "kapal keruk saat Kandas").otherwise("kapal keruk").alias("query"), F.lit("a dredger aground").alias("query_en"))
    matches = part.select("query_id", F.when(F.col("p_partkey") % 3 == 2, "small_parts").otherwise("dredger_bottom_transverse_spacing_aground").alias("topic"))
    lists = spark.createDataFrame([], "topic string, aspects array<string>")
    found = O.precision(matches, asked, spark.createDataFrame(ASPECTS, "aspect string, term string"), lists, lists)
    return found.select("query_id", "reason")


@query("rules_validated", "SELECT p_partkey AS rule_id, p_type AS topic, p_size AS section_no FROM part")
def rules_validated(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("topic"), F.col("p_name").alias("value_text"), F.col("p_size").alias("section_no"), F.split("p_name", " ").alias("trigger_terms"))
    return O.validated(rules).select("rule_id", "topic", "section_no")


@query(
    "localized_text",
    """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN coalesce(nullif(en, ''), nullif(lo, ''), p_name) ELSE coalesce(nullif(lo, ''), nullif(en, ''), p_name) END AS body
       FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand END AS en, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN p_type || '..' END AS lo FROM part)""",
)
def localized_text(spark, sf_dir):
    en = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    local = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, F.concat("p_type", F.lit("..")))
    lang = F.when(F.col("p_size") % 2 == 0, "en").otherwise("id")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), O.localised(lang, en, local, F.col("p_name")).alias("body"))


@query(
    "lookup_evidence",
    """SELECT p_partkey AS id, regexp_replace(p_type || '..', '\\.+$', '') || ' (Sec 5 | C.2 p.7).' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'Source quote' ELSE 'Kutipan sumber' END || ': "' || p_name || '"' AS body FROM part""",
)
def lookup_evidence(spark, sf_dir):
    from ..functions.text import citation

    cite = citation(F.lit(5), F.lit("C.2"), F.lit(7), F.lit(7))
    lang = F.when(F.col("p_size") % 2 == 0, "en").otherwise("id")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), O.evidence(lang, F.concat("p_type", F.lit("..")), cite, F.col("p_name")).alias("body"))


@query(
    "term_match",
    f"""WITH z(term) AS (VALUES {values([("RING",), ("WIDGET",), ("in",), ("bol",), ("Red  Widget!",)])}) SELECT p_partkey AS id, term FROM part JOIN z ON
          CASE WHEN term IN ('RING', 'WIDGET', 'in') THEN contains(' ' || {_NORM("p_name")} || ' ', ' ' || lower(term) || ' ') ELSE contains({_NORM("p_name")}, {_NORM("term")}) END""",
)
def term_match(spark, sf_dir):
    terms = ["RING", "WIDGET", "in", "bol", "Red  Widget!"]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), normalise(F.col("p_name")).alias("t"))
    return rows.select("id", F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: term_matches(F.col("t"), t))).alias("term"))
