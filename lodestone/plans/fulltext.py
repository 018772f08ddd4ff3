"""Queries of positional full-text search over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stemming import stem_sql, with_stem
from ..operators import expansion as X
from ..operators import fulltext as T
from ..operators.retrieval import RRF_K
from ..sources.stored import shared_folder
from .base import query, table, values

SEARCHES = {
    0: "ered tion",
    1: '"all rights reserved" or licensing',
    2: "Erings -ble -\"tion of\"",
    3: 'die or les "rights reserved" -apache',
    4: "nowhere ing",
    5: "the of",
    6: "ly ed ings",
    7: '"ing tion" or "ed the ly"',
}

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_POSITIONS = f"SELECT * FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS word, unnest(range(1, len({_TOKENS}) + 1)) AS pos FROM documents) WHERE word NOT IN ({_STOPS})"


def _search_sql(k: int, searches: dict[int, str] = SEARCHES) -> str:
    rows = [(q, len(found), a, u, b, w, o) for q, text in searches.items() for found in [T.parse_search(text)] for a, units in enumerate(found) for u, (b, words) in enumerate(units) for w, o in words]
    rows = [tuple(int(x) if isinstance(x, bool) else x for x in r) for r in rows]
    chance = f"{T.WEIGHT} * sqrt(1 / (1.005 + 0.05 * exp(abs(b.pos - a.pos) / 1.5::DOUBLE - 2)))"
    return f"""
WITH asked AS (SELECT * FROM (VALUES {values(rows)}) AS v(query_id, n_alt, alt, unit, banned, word, off)),
p AS ({_POSITIONS}),
stems AS (SELECT word, stem FROM ({stem_sql("SELECT DISTINCT word FROM (SELECT word FROM p UNION ALL SELECT word FROM asked)")})),
q AS (SELECT query_id, n_alt, alt, unit, banned, off, stem FROM asked JOIN stems USING (word)),
t AS (SELECT id, stem, pos FROM p JOIN stems USING (word) WHERE stem IN (SELECT stem FROM q)),
stands AS (
  SELECT DISTINCT query_id, alt, unit, banned, id FROM (
    SELECT query_id, alt, unit, banned, id, pos - off AS start, count(*) AS n FROM q JOIN t USING (stem) GROUP BY ALL) x
  JOIN (SELECT query_id, alt, unit, count(*) AS need FROM q GROUP BY ALL) USING (query_id, alt, unit) WHERE n = need),
found AS (
  SELECT DISTINCT query_id, id FROM (
    SELECT query_id, alt, id, count(*) FILTER (banned = 0) AS n, count(*) FILTER (banned = 1) AS bad FROM stands GROUP BY ALL)
  JOIN (SELECT query_id, alt, count(DISTINCT unit) AS need FROM q WHERE banned = 0 GROUP BY ALL) USING (query_id, alt) WHERE n = need AND bad = 0),
size AS (SELECT query_id, any_value(n_alt) AS n_alt, count(DISTINCT stem) AS n_stems FROM q GROUP BY query_id),
own AS (SELECT DISTINCT query_id, stem FROM q),
held AS (SELECT query_id, id, stem, pos FROM found JOIN own USING (query_id) JOIN t USING (id, stem)),
near AS (
  SELECT a.query_id, a.id, sum(ln(1 - {chance})) AS logs FROM held a JOIN held b ON a.query_id = b.query_id AND a.id = b.id AND a.stem < b.stem AND abs(a.pos - b.pos) <= {T.REACH}
  GROUP BY ALL),
often AS (
  SELECT query_id, id, sum(list_sum(list_transform(range(1, n + 1), lambda j: 1.0::DOUBLE / (j * j)))) AS total FROM (SELECT query_id, id, stem, count(*) AS n FROM held GROUP BY ALL) GROUP BY ALL),
scored AS (
  SELECT query_id, id, round(CASE WHEN n_alt = 1 AND n_stems > 1 THEN 1 - exp(coalesce(logs, 0)) ELSE {T.WEIGHT}::DOUBLE * total / {T.SUM_OF_SQUARES}::DOUBLE / n_stems END, 6) AS score
  FROM found JOIN size USING (query_id) JOIN often USING (query_id, id) LEFT JOIN near USING (query_id, id))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score FROM scored QUALIFY rank <= {k}"""


@query("fulltext_positional", _search_sql(40))
def fulltext_positional(spark, sf_dir):
    """The index of all documents is stored, then searched."""
    index = T.store_index(table(spark, sf_dir, "documents"), shared_folder(spark, "fulltext"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return T.search(index, spark.createDataFrame(list(SEARCHES.items()), "query_id int, query string"), 40)


@query(
    "positional_postings",
    f"""WITH p AS ({_POSITIONS}), stems AS (SELECT word, stem FROM ({stem_sql("SELECT DISTINCT word FROM p")}))
        SELECT id, stem, list(pos::INTEGER ORDER BY pos) AS positions FROM p JOIN stems USING (word) GROUP BY ALL""",
)
def positional_postings(spark, sf_dir):
    return T.postings(table(spark, sf_dir, "documents")).select("id", "stem", "positions")


@query("stemmed_words", f"SELECT stem, count(*) AS n_words, sum(n) AS n_occurrences FROM ({stem_sql(f'SELECT word, count(*) AS n FROM ({_POSITIONS}) GROUP BY word')}) GROUP BY stem")
def stemmed_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).where(~F.col("word").isin(*T.STOP_WORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return with_stem(words).groupBy("stem").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").cast("decimal(38,0)").alias("n_occurrences"))


#: What the stand-in model answers: a numbered line a paraphrase, in odd shapes.
PARAPHRASES = {0: "1. ers tions\n2) 'erings or ereds'\n- ER\n3. ers tions", 2: "tions\n\n4. ing -ble", 4: "", 7: None}
_VARIANTS = {0: ["ered tion", "ers tions", "erings or ereds"], 2: [SEARCHES[2], "tions", "ing -ble"], 4: [SEARCHES[4]], 7: [SEARCHES[7]]}


@query(
    "expansion_fused",
    f"""WITH f AS ({_search_sql(40, {10 * q + v: text for q, texts in _VARIANTS.items() for v, text in enumerate(texts)})}),
        s AS (SELECT query_id // 10 AS query_id, id, round(sum(1.0::DOUBLE / ({RRF_K} + rank)), 9) AS score, count(*) AS variants FROM f GROUP BY ALL)
        SELECT query_id::INTEGER AS query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score, variants FROM s QUALIFY rank <= 20""",
)
def expansion_fused(spark, sf_dir):
    """Each search, its paraphrases by a stand-in model, all of them searched and fused by rank."""
    index = T.store_index(table(spark, sf_dir, "documents"), shared_folder(spark, "fulltext"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = spark.createDataFrame([(q, SEARCHES[q]) for q in PARAPHRASES], "query_id int, query string")
    said = F.create_map(*[F.lit(x) for q, text in PARAPHRASES.items() for x in (SEARCHES[q], text)])
    found = X.expanded_search(asked, lambda text: F.try_element_at(said, text), lambda searches, k: T.search(index, searches, k), 20)
    return found.select("query_id", "rank", "id", "score", "variants")
