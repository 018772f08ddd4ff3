"""Queries of ingest, evaluation and table edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import ingest as I
from ..sources import tables as S
from .base import query, table, values


def pages(spark, sf_dir):
    """Every document as a page; a heading after each seventh line."""
    docs = table(spark, sf_dir, "documents")
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 7 == 6, F.concat(x, F.lit("\nB.\n2.1\n"))).otherwise(x)), "\n")
    return docs.select(
        F.col("doc_id").alias("page_no"),
        F.substring("source", 4, 9).cast("int").alias("section_no"),
        F.col("lang").alias("section_title"),
        text.alias("text"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.struct(F.lit("3.1").alias("table_no"), F.lit("a | b").alias("text")))).alias("tables"),
    )


_HEAD = "'[Sec ' || section_no || ' ' || coalesce(section_title, 'None')"
#: The fold over a page's lines as a recursion, a line a step; a heading closes a chunk that is over the limit.
_CHUNKS = rf"""WITH RECURSIVE p AS (SELECT doc_id AS page_no, substr(source, 4)::INTEGER AS section_no, lang AS section_title, list_filter(list_transform(
        string_split(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 = 6 THEN x || chr(10) || 'B.' || chr(10) || '2.1' || chr(10) ELSE x END), chr(10)), chr(10)),
        lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents WHERE substr(source, 4)::INTEGER <> 0),
      f AS (SELECT page_no, ls, 0 AS n, '' AS text, NULL::VARCHAR AS para, NULL::VARCHAR AS first, '' AS major, NULL::VARCHAR AS out_text, NULL::VARCHAR AS out_para FROM p
        UNION ALL SELECT page_no, ls, n + 1, CASE WHEN t = '' THEN line ELSE t || chr(10) || line END, now, CASE WHEN is_para THEN coalesce(f1, now) ELSE f1 END, CASE WHEN is_major THEN line[1] ELSE major END, CASE WHEN closes THEN text END, CASE WHEN closes THEN coalesce(first, para) END
          FROM (SELECT *, CASE WHEN closes THEN '' ELSE text END AS t, CASE WHEN NOT closes THEN first END AS f1, CASE WHEN is_para THEN CASE WHEN major <> '' THEN major || '.' || line ELSE line END ELSE para END AS now
            FROM (SELECT *, (is_major OR is_para) AND floor(length(text) / 4) > {I.CHUNK_TOKENS} AS closes FROM (SELECT *, ls[n + 1] AS line, regexp_matches(ls[n + 1], '{I.MAJOR}') AS is_major, regexp_matches(ls[n + 1], '{I.PARAGRAPH}') AS is_para FROM f WHERE n < len(ls))))),
      c AS (SELECT page_no, n, out_text AS text, out_para AS para FROM f WHERE out_text IS NOT NULL UNION ALL SELECT page_no, n + 1, text, coalesce(first, para) FROM f WHERE n = len(ls) AND text <> ''),
      o AS (SELECT page_no, section_no, section_title, 0 AS n, 'table' AS content_type, NULL::VARCHAR AS paragraph_id, '3.1' AS table_no, 'a | b' AS text FROM p WHERE page_no % 5 = 0
        UNION ALL SELECT page_no, section_no, section_title, n, CASE WHEN contains(lower(text), 'where') AND len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '=') AND length(trim(x)) < 80)) > 0 THEN 'formula' ELSE 'narrative' END, para, NULL, text FROM c JOIN p USING (page_no))
      SELECT page_no, section_no, (row_number() OVER (PARTITION BY page_no ORDER BY n) - 1)::INTEGER AS chunk_no, content_type, paragraph_id, table_no,
        {_HEAD} || CASE WHEN table_no IS NOT NULL THEN ' | Table ' || table_no WHEN coalesce(paragraph_id, '') <> '' THEN ' | ' || paragraph_id ELSE '' END || ']' || chr(10) || text AS content FROM o"""


@query("chunk_documents", _CHUNKS)
def chunk_documents(spark, sf_dir):
    out = I.chunk_pages(pages(spark, sf_dir))
    return out.select("page_no", "section_no", "chunk_no", "content_type", "paragraph_id", "table_no", "content")


@query(
    "chunk_type",
    """SELECT doc_id, floor(length(text) / 4)::BIGINT AS tokens, contains(lower(text), 'where') AND len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '=') AND length(trim(x)) < 80)) > 0 AS formula
       FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'where a = b' ELSE text END AS text FROM documents)""",
)
def chunk_type(spark, sf_dir):
    from ..functions.text import estimated_tokens

    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nwhere a = b"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", estimated_tokens(F.col("text")).alias("tokens"), I.is_formula(F.col("text")).alias("formula"))


@query("figure_caption", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Fig. 3.' || p_size || ' ' || p_name WHEN 1 THEN 'FIGURE 2.1' END AS caption FROM part")
def figure_caption(spark, sf_dir):
    text = F.expr("CASE p_size % 3 WHEN 0 THEN 'see Fig. 1.1\\n  Fig. 3.' || p_size || ' ' || p_name || '\\nFig. 9.9' WHEN 1 THEN 'x\\nFIGURE 2.1\\n' ELSE 'Figure 3\\n' || p_name END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), I.figure_caption(text).alias("caption"))


@query("eval_entries", "SELECT p_partkey AS id, 'E-' || k AS entry, k % 2 = 0 AS should_reject FROM part, (SELECT unnest([1, 3]) AS k) WHERE p_partkey % 3 = k % 3")
def eval_entries(spark, sf_dir):
    """Entries read from text, some by id, joined to parts."""
    text = '[{"id": "E-1", "k": 1, "should_reject": false}, {"id": "E-2", "k": 2, "should_reject": true}, {"id": "E-3", "k": 3, "should_reject": false}]'
    entries = S.entries_from_yaml(spark, text, "id string, k long, should_reject boolean", ["E-1", "E-3"]).withColumnRenamed("id", "entry")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("at"))
    return part.join(entries.withColumn("at", F.col("k") % 3), "at").select("id", "entry", "should_reject")


@query(
    "section_header",
    """SELECT p_partkey AS id, CASE p_size % 3 WHEN 2 THEN NULL ELSE p_size END::INTEGER AS section_no, CASE p_size % 3 WHEN 2 THEN NULL ELSE p_name END AS section_title FROM part""",
)
def section_header(spark, sf_dir):
    text = F.expr("CASE p_size % 3 WHEN 0 THEN 'Rules\\nSec ' || p_size || '\\n ' || p_name || ' \\ntext' WHEN 1 THEN 'x\\nSec\\n' || p_size || '\\n' || p_name ELSE 'Sec x\\nSec\\n' || p_name END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), I.section_header(text).alias("h")).select("id", "h.section_no", "h.section_title")


@query(
    "table_text",
    """SELECT p_partkey AS id, '6.' || p_size AS table_no, p_name || ' x | ' || p_brand || chr(10) || ' | ' || p_size AS text FROM part""",
)
def table_text(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    cells = F.array(F.array(F.array(F.concat("p_name", F.lit("\nx ")), F.concat(F.lit(" "), "p_brand")), F.array(F.lit(None).cast("string"), F.col("p_size").cast("string"))))
    text = F.concat(F.lit("see Table 6."), F.col("p_size").cast("string"), F.lit(" and Table 7.1"))
    return rows.select(F.col("p_partkey").alias("id"), F.explode(I.table_texts(text, cells)).alias("t")).select("id", "t.table_no", "t.text")


@query(
    "block_filter",
    """SELECT p_partkey AS id, 'C.' || chr(10) || 'first' || chr(10) || p_name || CASE WHEN p_size <= 25 THEN chr(10) || p_brand ELSE '' END AS text FROM part""",
)
def block_filter(spark, sf_dir):
    b = lambda x0, y0, x1, y1, t: F.struct(F.lit(x0).cast("double").alias("x0"), F.lit(y0).cast("double").alias("y0"), F.lit(x1).cast("double").alias("x1"), F.lit(y1).cast("double").alias("y1"), t.alias("text"))
    size = F.col("p_size").cast("double")
    blocks = F.array(
        b(0, 50, 10, 60, F.col("p_name")), b(0, 40, 10, 45, F.lit(" first ")), b(0, 0, 10, 5, F.lit("Rules for everything\nC.")), b(0, 90, 10, 95, F.lit("Page 7")),
        F.struct(F.lit(0.0).alias("x0"), F.lit(70.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(80.0).alias("y1"), F.col("p_brand").alias("text")), b(0, 61, 1, 62, F.lit(" ")),
    )
    boxes = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(70.0).alias("y0"), size.alias("x1"), F.lit(80.0).alias("y1")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), I.narrative(blocks, boxes, ["Rules for"], ["Printed by"]).alias("text"))


_ENTRIES = """SELECT doc_id, quality, toxic, CASE WHEN doc_id % 7 = 0 THEN 'calc-value' WHEN toxic = 1 THEN 'guardrail' WHEN doc_id % 5 = 0 THEN 'lookup_negative' WHEN quality = 1 THEN 'lookup' ELSE 'rules_qa' END AS category, lang, text, (doc_id % 10) / 4.0 AS elapsed FROM labels JOIN documents USING (doc_id)"""


def graded(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    false = F.lit(False)
    flags = {"has_turns": false, "expect_no_lookup": F.col("doc_id") % 5 == 0, "expect_lookup": F.col("quality") == 1, "should_reject": F.col("toxic") == 1, "expect_error": false, "expect_clarification": false, "has_result": F.col("doc_id") % 7 == 0}
    rows = rows.withColumn("category", E.category(flags))
    rows = rows.select(
        "doc_id", "category", F.col("text").alias("answer"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).otherwise("en").alias("lang"),
        F.array(F.substring("source", 4, 9).cast("int")).alias("sections"), F.when(F.col("doc_id") % 3 == 0, F.array(*[F.lit(x) for x in range(10)])).alias("expected_sections"),
        F.array(F.lit("e"), F.lit("N")).alias("must_include"), F.array(F.array(F.lit("th"), F.lit("ch, "), F.lit("qu"))).alias("any_groups"), F.array(F.lit("all rights")).alias("must_not"),
        ((F.col("doc_id") % 10) / 4.0).alias("elapsed"),
    )
    return E.grade_answer(rows)


_PLAIN = r"regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(replace(lower(text), ',', '.'), '([0-9])\s*%', '\1 percent', 'g'), '\bsqrt\b', 'square root', 'g'), '√', 'square root'), '×', 'x'), '·', 'x'), '\s+', '', 'g')"
_GRADED = f"""g AS (SELECT *, l AND k AND s AS passed FROM (SELECT doc_id, category, elapsed, doc_id % 4 > 0 OR lang = 'en' AS l,
    contains(a, 'e') AND contains(a, 'n') AND (contains(a, 'th') OR contains(a, 'ch.') OR contains(a, 'qu')) AND NOT contains(a, 'allrights') AS k, doc_id % 3 > 0 OR src < 10 AS s
  FROM (SELECT e.*, {_PLAIN} AS a, substr(source, 4)::INTEGER AS src FROM ({_ENTRIES}) e JOIN (SELECT doc_id, source FROM documents) USING (doc_id))))"""


@query("eval_grade", f"WITH {_GRADED} SELECT doc_id, category, l AS language_ok, k AS keywords_ok, s AS section_ok, passed FROM g")
def eval_grade(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "category", "language_ok", "keywords_ok", "section_ok", "passed")


@query(
    "eval_summary",
    f"WITH {_GRADED} SELECT category, sum(passed::INT)::BIGINT AS passed, count(*) AS total, round(100.0::DOUBLE * sum(passed::INT) / count(*), 1) AS rate, round(avg(elapsed), 3) AS mean_seconds FROM g GROUP BY category",
)
def eval_summary(spark, sf_dir):
    return E.summary(graded(spark, sf_dir))


@query("eval_rates", f"WITH {_GRADED} SELECT count(*) AS total, round(100.0 * avg(l::INT), 1) AS language_ok, round(100.0 * avg(k::INT), 1) AS keywords_ok, round(100.0 * avg(passed::INT), 1) AS passed FROM g")
def eval_rates(spark, sf_dir):
    return E.rates(graded(spark, sf_dir), ["language_ok", "keywords_ok", "passed"])


@query("eval_numbers", "SELECT l_orderkey, l_linenumber, l_discount <= 0.05 AND l_linenumber % 2 = 0 AS passed FROM lineitem")
def eval_numbers(spark, sf_dir):
    text = F.format_string("...\nResult: %.2f %s\n", F.col("l_quantity") + F.col("l_discount"), F.when(F.col("l_linenumber") % 2 == 0, "mm").otherwise("kN"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", E.stated_number(F.regexp_replace(text, r"\.([0-9])", ",$1")).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", E.grade_number(F.col("r.value"), F.col("r.unit"), F.col("l_quantity"), F.lit("MM"), F.lit(0.051)).alias("passed"))


#: Answers and how they compare.
_NOTATIONS = [("1, 21  x", "1.21x"), ("5 %", "5percent"), ("5 percent", "5percent"), ("% of", "%of"), ("SQRT(L) and sqrtx", "squareroot(l)andsqrtx"), ("√ℓ", "squarerootl"), ("2·3×4", "2x3x4"), ("Ａ１２ ㎜²", "a12mm2"), ("ﬁne ½", "fine1⁄2"), ("a b", "ab"), ("", "")]


@query("answer_normalise", f"WITH n(k, plain) AS (VALUES {values([(k, x) for k, (_, x) in enumerate(_NOTATIONS)])}) SELECT p_partkey AS id, plain || p_size AS plain FROM part JOIN n ON p_partkey % {len(_NOTATIONS)} = k")
def answer_normalise(spark, sf_dir):
    from ..functions.text import comparable_answer

    given = F.get(F.array(*[F.lit(x) for x, _ in _NOTATIONS]), F.col("p_partkey") % len(_NOTATIONS))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), comparable_answer(F.concat(given, F.lit(" "), F.col("p_size").cast("string"))).alias("plain"))


@query(
    "eval_lookup",
    """SELECT p_partkey AS id, list_filter([CASE WHEN p_size % 5 = 0 THEN 'language' END, CASE WHEN NOT contains(lower(p_name), 'red') THEN 'missing:RED' END, CASE WHEN NOT contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'bol') THEN 'none of:ring|Bol' END,
         CASE WHEN contains(lower(p_name), 'wid') THEN 'forbidden:w id' END], lambda x: x IS NOT NULL) AS failures, len(failures) = 0 AS passed, p_size % 2 = 0 AS fired FROM part""",
)
def eval_lookup(spark, sf_dir):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("answer"), F.lit("en").alias("language"), F.when(F.col("p_size") % 5 > 0, "en").alias("lang"), words("RED").alias("must_include"), F.array(words("ring", "Bol")).alias("any_groups"),
        words("w id").alias("must_not"), F.when(F.col("p_size") % 2 == 0, "topic").alias("lookup_topic"),
    )
    return E.grade_lookup(rows).select("id", "failures", "passed", "fired")


@query(
    "eval_lookup_negative",
    """SELECT p_partkey AS id, list_filter([CASE WHEN p_size % 3 = 0 THEN 'fired:plain' END, CASE WHEN p_size % 2 = 0 AND p_size > 20 THEN 'sections' END, CASE WHEN p_size % 2 = 0 AND p_size % 7 = 0 THEN 'refused' END,
         CASE WHEN NOT contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'bol') THEN 'none of:Ring|bol' END, CASE WHEN contains(lower(p_name), 'wid') THEN 'forbidden:wid' END], lambda x: x IS NOT NULL) AS failures, len(failures) = 0 AS passed FROM part""",
)
def eval_lookup_negative(spark, sf_dir):
    size, words = F.col("p_size"), lambda *w: F.array(*[F.lit(x) for x in w])
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.when(size % 7 == 0, ", the Context is insufficient").otherwise("")).alias("answer"), F.when(size % 3 == 0, "plain").alias("lookup_topic"), F.array(size).alias("sections"),
        F.when(size % 2 == 0, F.sequence(F.lit(1), F.lit(20))).alias("expected_sections"), words("Ring", "bol").alias("must_include_any"), words("wid").alias("must_not"),
    )
    return E.grade_lookup_negative(rows).select("id", "failures", "passed")


@query("eval_guardrail", "SELECT doc_id, toxic = 1 AS passed FROM labels")
def eval_guardrail(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", E.grade_guardrail(F.when(F.col("toxic") == 1, True)).alias("passed"))


def conversation_turns(spark, sf_dir):
    """Every row a turn with an answer; its condensed question names the conversation from the second turn on, and is missing in some."""
    rows = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<string>")
    return rows.select(
        "conv_id", "turn", F.concat(F.lit("q"), F.col("turn").cast("string")).alias("question"), F.when(F.col("turn") % 3 > 0, F.col("text")).otherwise("").alias("answer"), F.lit("id").alias("language"), F.lit("id").alias("lang"),
        F.array(F.lit(1)).alias("sections"), F.array(F.lit(1), F.lit(2)).alias("expected_sections"), none.alias("must_include"), F.array().cast("array<array<string>>").alias("any_groups"), F.array(F.lit("zzz")).alias("must_not"),
        F.when(F.col("conv_id") % 4 > 0, F.concat(F.lit("about L = "), F.col("turn").cast("string"))).alias("en_query"), F.when(F.col("turn") % 2 == 1, F.array(F.lit("L="), F.lit("1"))).alias("en_query_contains"),
    )


_TURNS_OK = "CASE WHEN turn % 2 = 1 THEN conv_id % 4 > 0 AND contains(turn::VARCHAR, '1') ELSE true END AND NOT (turn % 3 > 0 AND contains(regexp_replace(lower(text), '\\s+', '', 'g'), 'zzz'))"


@query("eval_multi_turn", f"SELECT conv_id, bool_and(ok) AS passed, count(*) AS turns, list_sort(coalesce(list(turn) FILTER (NOT ok), [])) AS failed FROM (SELECT *, {_TURNS_OK} AS ok FROM conversations) GROUP BY conv_id")
def eval_multi_turn(spark, sf_dir):
    return E.multi_turn(E.grade_turns(conversation_turns(spark, sf_dir)))


@query(
    "eval_history",
    """SELECT conv_id, turn, list_transform(coalesce(flatten(list(m) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []), lambda x: x) AS history
       FROM (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 AND text <> '' THEN ['user:q' || turn, 'assistant:' || text] ELSE ['user:q' || turn] END AS m FROM conversations)""",
)
def eval_history(spark, sf_dir):
    return E.with_history(conversation_turns(spark, sf_dir)).select("conv_id", "turn", F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["text"])).alias("history"))


@query("dup_ids", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return E.duplicates(table(spark, sf_dir, "conversations"), "conv_id")


@query("eval_composition", "SELECT 'lang' AS \"column\", lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL")
def eval_composition(spark, sf_dir):
    return E.composition(table(spark, sf_dir, "documents"), ["lang", "source"])


@query(
    "cache_upsert",
    """SELECT c_custkey AS id, coalesce(o, c_mktsegment) AS value, o IS NOT NULL AS fresh FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def cache_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"), F.lit(False).alias("fresh"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("value")).withColumn("fresh", F.lit(True))
    known = new.join(old.select("id"), "id", "left_semi")
    return S.upsert(old, known, ["id"])


@query("cache_lookup", "SELECT o_orderkey AS id, c_mktsegment AS hit FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 4) ON o_custkey = c_custkey")
def cache_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    cache = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("hit"), F.col("c_nationkey").alias("condense_version"))
    return S.look_up(asked, cache, "key", 4).select("id", "hit")


@query("seed_newest", "SELECT o_custkey AS id, max(o_orderkey) AS newest, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY o_custkey")
def seed_newest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("newest"), F.col("o_orderpriority").alias("value"))
    return S.newest(rows, ["id"], "newest")


@query("guarded_update", "SELECT p_partkey AS id, CASE WHEN p_size = 7 AND p_brand = 'Brand#2' THEN replace(p_name, 'r', 'R') ELSE p_name END AS name FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT -1, 'new'")
def guarded_update(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    changed = S.guarded_update(part, (F.col("p_size") == 7) & (F.col("p_brand") == "Brand#2"), {"p_name": F.replace(F.col("p_name"), F.lit("r"), F.lit("R"))})
    rows = changed.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_type")
    new = spark.createDataFrame([(-1, "new", "x")], "id long, name string, p_type string")
    return S.replace_where(rows, F.col("p_type") == "PROMO", new).select("id", "name")


@query("verified_scan", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 25 AND p_brand = 'Brand#2'")
def verified_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("verified", F.col("p_size") > 25)
    return S.verified(rows, p_brand="Brand#2").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
