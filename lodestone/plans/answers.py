"""Queries of re-ranking with the stand-in, answer messages, math text and batch analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mathtext import format_math_column
from ..operators import answers as A
from ..providers import OverlapReranker, rerank
from ..streaming.queries import analysed
from ..operators.analysis import OUT_OF_SCOPE
from .analysis import _TURN as TURN
from .analysis import GLOSSARY
from .base import ORACLES, query, table, values
from .scoring import HITS, hits, questions

_W = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(
    "rerank_topk",
    f"""WITH {HITS}, q(query_id, t) AS (VALUES ('en', 'the thing of and'), ('de', 'die und ein'), ('fr', 'les que des'), ('es', 'una los')),
        s AS (SELECT h.query_id, id, pos, len(list_intersect({_W("t")}, {_W("left(content, 2048)")})) / len({_W("t")})::DOUBLE AS score FROM hits h JOIN q ON h.query_id = q.query_id)
        SELECT query_id, id, round(score, 6) AS score, pos FROM (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos))::INTEGER AS pos FROM s) WHERE pos <= 8""",
)
def rerank_topk(spark, sf_dir):
    asked = spark.createDataFrame([("en", "the thing of and"), ("de", "die und ein"), ("fr", "les que des"), ("es", "una los")], "query_id string, query string")
    out = rerank(hits(spark, sf_dir).join(F.broadcast(asked), "query_id"), OverlapReranker, 8)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "pos")


@query(
    "answer_prompt",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Calculation:' || chr(10) || '7,5 mm' WHEN turn % 3 = 1 THEN 'Rule:' || chr(10) || role ELSE 'Context:' || chr(10) || text END || chr(10) || chr(10) || 'Question: ' || text
         || chr(10) || chr(10) || 'Answer in ' || CASE WHEN role = 'user' THEN 'English' ELSE 'the language of the question' END || '.' || chr(10) || chr(10)
         || CASE WHEN turn % 2 = 0 THEN 'Answer in a few sentences. Cite the sections you use.' ELSE 'Answer in one to three paragraphs. Cite the sections you use.' END AS prompt FROM conversations""",
)
def answer_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    third = F.col("turn") % 3
    prompt = A.answer_prompt(
        F.col("text"), F.when(F.col("role") == "user", "en").otherwise("xx"), F.when(F.col("turn") % 2 == 0, "fast").otherwise("default"),
        F.when(third == 0, "7,5 mm"), F.when(third == 1, F.col("role")), F.col("text"),
    )
    return rows.select("conv_id", "turn", prompt.alias("prompt"))


#: Markup and the plain text that the reference's behaviour asks for, each for a part.
MATH = [
    (r"\[ tp \geq 600 \times 100 = 60000 \text{ mm} \]", "tp ≥ 600 × 100 = 60000 mm"), ("$x = 5$", "x = 5"), (r"\frac{600}{100}", "600/100"), (r"\frac{a + b}{c}", "(a + b)/c"),
    (r"\(\alpha + \beta\)", "alpha + beta"), ("$$a$$", "a"), (r"\sqrt{25}", "sqrt(25)"), ("x^{2}", "x^2"), ("x_{max}", "x_max"), (r"E:\Project\some-folder", r"E:\Project\some-folder"), (r"C:\Users\x", r"C:\Users\x"),
    ("", ""), (r"\left( \frac{1}{2} \right)", "(1/2)"), (r"\alpha test", "alpha test"), ("a_b^{c}", "a_b^c"), ("plain text, 6 mm.", "plain text, 6 mm."), (r"4 \mathrm{kN} \cdot 2 \pm 1", "4 kN · 2 ± 1"),
]


@query("math_format", f"WITH m(k, text) AS (VALUES {values([(k, t) for k, (_, t) in enumerate(MATH)])}) SELECT p_partkey AS id, text || ' ' || p_size AS text FROM part JOIN m ON p_partkey % {len(MATH)} = k WHERE text <> ''")
def math_format(spark, sf_dir):
    markup = F.array(*[F.lit(x) for x, _ in MATH])
    rows = table(spark, sf_dir, "part").withColumn("markup", F.get(markup, F.col("p_partkey") % len(MATH))).where("markup <> ''")
    return rows.select(F.col("p_partkey").alias("id"), format_math_column(F.concat("markup", F.lit(" "), F.col("p_size").cast("string"))).alias("text"))


_PARTS = f"""WITH l AS (SELECT conv_id, turn, language FROM ({ORACLES["language_markers"].replace("doc_id", "conv_id, turn").replace("documents", "conversations")})),
      i AS (SELECT conv_id, turn, kind AS intent FROM ({ORACLES["intent_classify"].replace(TURN, "text")})), o AS (SELECT conv_id, turn, list_filter({OUT_OF_SCOPE!r}, lambda s: contains(lower(coalesce(text, '')), s))[1] AS out_of_scope FROM conversations),
      g AS (SELECT conv_id, turn, text AS english FROM ({ORACLES["glossary_apply"]}))"""


@query(
    "analyse_batch",
    rf"""{_PARTS} SELECT c.*, language, intent, out_of_scope, english, sha256('4|' || language || '|default|' || lower(regexp_replace(regexp_replace(text, '^ +| +$', '', 'g'), '\s+', ' ', 'g'))) AS query_hash
        FROM conversations c JOIN l USING (conv_id, turn) JOIN i USING (conv_id, turn) JOIN o USING (conv_id, turn) JOIN g USING (conv_id, turn)""",
)
def analyse_batch(spark, sf_dir):
    return analysed(table(spark, sf_dir, "conversations"), GLOSSARY)


@query(
    "boost_metadata",
    """SELECT p_partkey AS query_id, ship_type, section_no, boost FROM part JOIN (VALUES (0, 'tanker', 24, 2.0::DOUBLE), (1, 'bulk carrier', 23, 2.0), (2, 'liquefied gas', 26, 2.0)) t(k, ship_type, section_no, boost) ON p_size % 5 = k""",
)
def boost_metadata(spark, sf_dir):
    from ..operators import scoring as S

    small = spark.createDataFrame(S.SHIP_TYPES, "ship_type string, section_no int, boost double")
    query_of = F.expr("p_name || CASE p_size % 5 WHEN 0 THEN ' of a Tanker' WHEN 1 THEN ' of a bulk carrier' WHEN 2 THEN ' for liquefied gas or a tug' ELSE ' deck' END")
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), S.first_keyword(query_of, [t[0] for t in S.SHIP_TYPES]).alias("ship_type"))
    return found.join(F.broadcast(small), "ship_type").select("query_id", "ship_type", "section_no", "boost")


@query(
    "answer_messages",
    f"""WITH t AS (SELECT conv_id, max(turn) AS latest FROM conversations WHERE role = 'user' GROUP BY conv_id),
        h AS (SELECT c.conv_id, c.turn, c.role, c.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS back FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn < latest WHERE trim(coalesce(c.text, '')) <> '' AND c.role IN ('user', 'assistant')),
        m AS (SELECT conv_id, -1 AS turn, 'system' AS role, {values([(A.SYSTEM,)])} AS content FROM t
              UNION ALL SELECT conv_id, turn, role, text FROM h WHERE back <= 6
              UNION ALL SELECT t.conv_id, latest, 'user', coalesce(text, '') FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = latest)
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS place, role, content FROM m""",
)
def answer_messages(spark, sf_dir):
    """The messages for the latest user turn of each conversation, with what was said before it."""
    said = table(spark, sf_dir, "conversations")
    latest = said.where("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("q"))
    before = said.join(latest, "conv_id").where(F.col("turn") < F.col("q.turn")).groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("history"))
    rows = latest.join(before, "conv_id", "left").select("conv_id", A.answer_messages(F.col("q.text"), F.col("history")).alias("messages"))
    return rows.select("conv_id", F.posexplode("messages").alias("place", "m")).select("conv_id", "place", "m.role", "m.content")
