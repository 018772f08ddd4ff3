"""Queries of the formula engine, with values stated in texts made of ``part`` and ``lineitem`` columns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import formulas as O
from .base import query, table, values

_DECK = "'plate a=' || (200 + p_size * 10) || ' mm pL=' || p_size || ',5 kN/m2' || CASE WHEN p_size % 3 = 0 THEN ' mild steel' WHEN p_size % 3 = 1 THEN ' k=0.78' ELSE ' high tensile' END"


@query(
    "formula_eval",
    f"""SELECT id, status, CASE WHEN status = 'ok' THEN round(1.21 * a * sqrt((p + 0.5) * k) + 1.0, 6) END AS result FROM (
          SELECT p_partkey AS id, (200 + p_size * 10) / 1000.0::DOUBLE AS a, p_size::DOUBLE AS p, CASE WHEN p_size % 3 = 1 THEN 0.78::DOUBLE ELSE 1.0::DOUBLE END AS k,
            CASE WHEN p_size % 3 = 2 THEN 'needs_k' ELSE 'ok' END AS status FROM part)""",
)
def formula_eval(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(_DECK).alias("query"))
    out = O.calculate(rows, O.BY_CODE["DECK_PLATING_CARGO"])
    return out.select(F.col("query_id").alias("id"), "status", F.round("result", 6).alias("result"))


@query(
    "formula_max_branch",
    """SELECT id, round(greatest(18.3 * 0.83 * 0.6 * sqrt(p / 200.2) + 1.0, 1.21 * 0.6 * sqrt(p) + 1.0), 6) AS result, p > 1000 AS warned FROM (SELECT p_partkey AS id, p_retailprice AS p FROM part)""",
)
def formula_max_branch(spark, sf_dir):
    text = F.format_string("longitudinal bottom plate L=120 m pB=%.2f kN/m2 stiffener spacing 0.6 m mild steel", F.col("p_retailprice"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("query"))
    out = O.calculate(rows, O.BY_CODE["BOTTOM_PLATING_L_GREATER_90"])
    return out.select(F.col("query_id").alias("id"), F.round("result", 6).alias("result"), F.array_contains("warnings", "pB is very large").alias("warned"))


@query(
    "formula_wheel_load",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'not_finite' ELSE 'ok' END AS status, CASE WHEN l_linenumber > 1 THEN round(l_quantity / (l_linenumber - 1) * (1 + l_discount), 6) END AS result FROM lineitem",
)
def formula_wheel_load(spark, sf_dir):
    text = F.format_string("wheel load Q=%.1f kN n: %d av=%.2f", F.col("l_quantity"), F.col("l_linenumber") - 1, F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("query"))
    return O.calculate(rows, O.BY_CODE["WHEEL_LOAD"]).select("l_orderkey", "l_linenumber", "status", F.round("result", 6).alias("result"))


@query(
    "variable_parse",
    """SELECT p_partkey AS id, unnest(['@spacing', 'L', 'x']) AS name, unnest([p_size + 0.5, p_partkey, -p_size]::DOUBLE[]) AS value, unnest(['mm', 'm', '']) AS unit FROM part""",
)
def variable_parse(spark, sf_dir):
    text = F.format_string("L: %d m, spacing = %d,5 mm x=-%d y=z", F.col("p_partkey"), F.col("p_size"), F.col("p_size"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(O.assignments(text)).alias("x"))
    return rows.select("id", "x.name", "x.value", "x.unit")


#: One question a part, of several kinds.
_ASK = """CASE p_size % 10 WHEN 0 THEN 'tebal pelat alas L=' || p_size || ' m pB=20' WHEN 1 THEN 'side shell plating thickness L=' || (p_size * 3) || ' pS=30'
  WHEN 2 THEN 'net thickness of a plate b=600 mm' WHEN 3 THEN 'fore peak floor thickness L=80' WHEN 4 THEN 'wheel load Q=100 n=4' WHEN 5 THEN 'plate thickness pB=30'
  WHEN 6 THEN 'centre girder web L=100' WHEN 7 THEN 'minimum deck plating thickness L=' || p_size WHEN 8 THEN 'height of the forepeak floor H=9' ELSE p_name END"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(_ASK).alias("query"))


def _catalogue_words():
    """(code, place, word), (code, phrase) of the synonyms and (code, name) as the SQL's tables."""
    text = {f.code: f"{f.code} {f.title} {f.notes}".lower() for f in O.CATALOGUE}
    in_words = [(f.code, w) for f in O.CATALOGUE for w in sorted(set(re.findall(r"\w+", text[f.code])))]
    synonyms = [(f.code, a) for f in O.CATALOGUE for a, b in O.SYNONYMS if b in text[f.code]]
    names = [(f.code, x) for f in O.CATALOGUE for x in sorted({v.symbol.lower() for v in f.variables} | {v.name.lower() for v in f.variables})]
    return in_words, synonyms, names


_WORDS, _SYNONYMS, _NAMES = _catalogue_words()
_ADDED = ", ".join(f"CASE WHEN contains(clean, '{a}') THEN {(b + (' plating' if a in O._PLATING else '')).split(' ')!r} ELSE [] END" for a, b in O.SYNONYMS)
_RANK = rf"""f(code, place) AS (VALUES {values([(f.code, k) for k, f in enumerate(O.CATALOGUE)])}), w(code, word) AS (VALUES {values(_WORDS)}), y(code, phrase) AS (VALUES {values(_SYNONYMS)}), v(code, name) AS (VALUES {values(_NAMES)}),
  a AS (SELECT p_partkey AS query_id, {_ASK} AS query FROM part),
  c AS (SELECT *, lower(regexp_replace(query, '\w+\s*[=:]\s*[0-9.,]+\s*', '', 'g')) AS clean, list_distinct(regexp_extract_all(query, '(\w+)\s*[=:]\s*[0-9.,]+', 1)) AS names FROM a),
  d AS (SELECT *, list_distinct(list_filter(flatten([regexp_split_to_array(clean, '\W+'), {_ADDED}]), lambda x: x <> '')) AS words FROM c),
  p AS (SELECT query_id, query, words, code, place, coalesce((SELECT sum(length(word)) FROM w WHERE w.code = f.code AND list_contains(words, word)), 0) + 15 * (SELECT count(*) FROM y WHERE y.code = f.code AND contains(clean, phrase))
      + 10 * (SELECT count(*) FROM v WHERE v.code = f.code AND list_contains(names, name)) AS base FROM d, f),
  r AS (SELECT query_id, code, place, (CASE WHEN code = '{O.SLENDER_CODE}' AND NOT (contains(lower(query), 'slenderness') OR contains(lower(query), 'kelangsingan') OR contains(lower(query), 'net thickness') OR contains(lower(query), 'ketebalan bersih')) THEN 0
      WHEN base > 0 AND (starts_with(code, 'BOTTOM_PLATING') AND list_has_any(words, ['bottom', 'shell']) OR starts_with(code, 'SIDE_PLATING') AND list_has_any(words, ['side', 'shell'])) THEN base + 30 ELSE base END)::INTEGER AS score FROM p)"""


@query("formula_rank", f"WITH {_RANK} SELECT query_id, code, place, score FROM r WHERE score > 0")
def formula_rank(spark, sf_dir):
    return O.rank_formulas(questions(spark, sf_dir))


@query(
    "formula_search",
    f"""WITH {_RANK}, n AS (SELECT *, (row_number() OVER o)::INTEGER AS n, lead(score) OVER o AS next FROM r WHERE score > 0 WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, place)),
        t AS (SELECT query_id, next IS NULL OR score > next + 25 OR score >= 1.5 * next AS clear FROM n WHERE n = 1)
        SELECT query_id, code, score, n FROM n JOIN t USING (query_id) WHERE n = 1 OR (NOT clear AND n <= 4)""",
)
def formula_search(spark, sf_dir):
    return O.search_formulas(O.rank_formulas(questions(spark, sf_dir)))


@query(
    "formula_select",
    """SELECT p_partkey AS query_id, CASE p_size % 10 WHEN 0 THEN 'BOTTOM_PLATING_L_LESS_90' WHEN 1 THEN CASE WHEN p_size * 3 >= 90 THEN 'SIDE_PLATING_L_GREATER_90' ELSE 'SIDE_PLATING_L_LESS_90' END
         WHEN 2 THEN 'PLATE_NET_THICKNESS_SLENDERNESS' WHEN 3 THEN 'FLOOR_PEAK_THICKNESS' WHEN 4 THEN 'WHEEL_LOAD' WHEN 6 THEN 'CENTRE_GIRDER_WEB' WHEN 7 THEN 'DECK_PLATING_MIN' WHEN 8 THEN 'FLOOR_HEIGHT_FOREPEAK' END AS code FROM part""",
)
def formula_select(spark, sf_dir):
    return O.select_formula(questions(spark, sf_dir)).select("query_id", "code")


#: Candidates, question, language -> hints: which of (length, loads, bottom or side) and the loads; whether the spacing is given.
_SHELL = ["BOTTOM_PLATING_L_LESS_90", "BOTTOM_PLATING_L_GREATER_90", "SIDE_PLATING_L_LESS_90", "SIDE_PLATING_L_GREATER_90"]
_STUCK = [
    (_SHELL, "plate thickness pB=30", "en", (0,), "", False),
    (_SHELL, "tebal pelat", "id", (0, 1), "pB, pS, pS1", False),
    (_SHELL[:2], "plate with L = 100 and b=600 mm", "en", (1,), "pB", True),
    (_SHELL[2:], "side plate, spacing a = 0.6", "xx", (0, 1), "pS, pS1", True),
    ([_SHELL[0], _SHELL[2]], "L=80 pS=3 b: 7", "id", (2,), "", True),
    (["WHEEL_LOAD"], "wheel", "en", (), "", False),
    ([], "", "en", (), "", False),
]


def _stuck_sql():
    rows = []
    for k, (_, _, lang, which, loads, spacing) in enumerate(_STUCK):
        lang = "id" if lang == "id" else "en"
        hints = [O.HINTS[lang][h].replace("%s", loads) for h in which]
        rows.append((k, "|".join(hints), "".join([O.OPENINGS[lang][not spacing], *[f"\n  - {h}" for h in hints]]) if hints else ""))
    return values(rows)


@query("formula_diagnose", f"WITH s(k, hints, message) AS (VALUES {_stuck_sql()}) SELECT p_partkey AS query_id, CASE WHEN hints = '' THEN [] ELSE string_split(hints, '|') END AS hints, message FROM part JOIN s ON p_partkey % {len(_STUCK)} = k")
def formula_diagnose(spark, sf_dir):
    cases = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(_STUCK)], "k long, candidates array<string>, query string, lang string")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") % len(_STUCK)).alias("k")).join(F.broadcast(cases), "k")
    return O.diagnose(rows.select("query_id", F.lit(None).cast("string").alias("code"), "candidates"), rows.select("query_id", "query", "lang"))


@query(
    "variables_json",
    "SELECT p_partkey AS id, 's' || p_size AS symbol, p_size % 2 = 0 AS required, CASE WHEN p_size % 3 = 0 THEN 1.5::DOUBLE END AS fallback FROM part",
)
def variables_json(spark, sf_dir):
    text = F.format_string('[{"symbol": "s%d", "name": "n", "unit": "mm"%s%s}]', F.col("p_size"), F.when(F.col("p_size") % 2 == 1, ', "required": false').otherwise(""), F.when(F.col("p_size") % 3 == 0, ', "default": 1.5').otherwise(""))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(O.decode_variables(text)).alias("v"))
    return rows.select("id", "v.symbol", "v.required", F.col("v.default").alias("fallback"))
