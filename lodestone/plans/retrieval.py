"""Queries of hybrid retrieval over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import retrieval as R
from ..operators import vector_index as V
from ..sources.stored import shared_folder
from .base import query, table

QUERY_ID, TEXT = 0, "ing than"

DISTANCE = "round(1.0 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).first()["embedding"]


def _vector_sql(pool: int) -> str:
    return f"""SELECT e.vec_id AS id, {DISTANCE} AS distance
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID}) q
      WHERE e.embedding IS NOT NULL ORDER BY distance, id LIMIT {pool}"""


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"


def _text_sql(pool: int, terms=("ing", "than")) -> str:
    tf = [f"len(list_filter(w, lambda x: x = '{t}'))" for t in terms]
    return f"""SELECT doc_id AS id, round({" + ".join(f"ln(1.0 + {x})" for x in tf)}, 6) AS score
      FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE {" AND ".join(f"{x} > 0" for x in tf)}
      ORDER BY score DESC, id LIMIT {pool}"""


def _hybrid_sql(k: int) -> str:
    pool = R.pool_size(k)
    return f"""
WITH v AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS vrank FROM ({_vector_sql(pool)})),
t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS frank FROM ({_text_sql(pool)})),
f AS (SELECT coalesce(v.id, t.id) AS id, vrank, frank,
        coalesce(1.0::DOUBLE / ({R.RRF_K} + vrank), 0) + coalesce(1.0::DOUBLE / ({R.RRF_K} + frank), 0) AS score
      FROM v FULL OUTER JOIN t ON v.id = t.id ORDER BY score DESC, id LIMIT {k})
SELECT f.id, vrank::BIGINT AS vrank, frank::BIGINT AS frank, round(score, 9) AS score, lang, source FROM f JOIN documents ON doc_id = f.id"""


def _hybrid(spark, sf_dir, k):
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    found = R.hybrid_search(docs, vecs, query_vector(spark, sf_dir), TEXT, k)
    return found.select("id", F.col("vrank").cast("long").alias("vrank"), F.col("frank").cast("long").alias("frank"), F.round("score", 9).alias("score"), "lang", "source")


@query("hybrid_rrf", _hybrid_sql(30))
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, 30)


@query(
    "rrf_fast_vs_default",
    f"SELECT 'fast' AS mode, * FROM ({_hybrid_sql(4)}) UNION ALL SELECT 'default' AS mode, * FROM (SELECT * FROM ({_hybrid_sql(30)}) ORDER BY score DESC, id LIMIT 8)",
)
def rrf_fast_vs_default(spark, sf_dir):
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    q = query_vector(spark, sf_dir)
    parts = []
    for mode in R.MODES.values():
        found = R.retrieve(docs, vecs, q, TEXT, mode)
        parts.append(found.select(F.lit(mode.name).alias("mode"), "id", F.col("vrank").cast("long").alias("vrank"), F.col("frank").cast("long").alias("frank"), F.round("score", 9).alias("score"), "lang", "source"))
    return parts[0].unionByName(parts[1])


@query("vector_topk", _vector_sql(40))
def vector_topk(spark, sf_dir):
    return R.vector_topk(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 40)


_MEANS = """SELECT label, list(x ORDER BY place) AS mean FROM (
         SELECT label, place, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings) GROUP BY label, place)
       GROUP BY label"""


def mean_of_labels(spark, sf_dir):
    out = vectors.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@query(
    "vector_topk_batch",
    f"""WITH m AS ({_MEANS}),
        s AS (SELECT label AS query_id, vec_id AS id, round(1.0 - list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS distance
          FROM (SELECT vec_id, embedding FROM embeddings), m WHERE embedding IS NOT NULL)
        SELECT query_id, rank, id, distance FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INTEGER AS rank FROM s) WHERE rank <= 40""",
)
def vector_topk_batch(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = mean_of_labels(spark, sf_dir).select(F.col("label").alias("query_id"), F.col("mean").alias("query_vector"))
    return R.vector_topk_batch(vecs, queries, 40).select("query_id", "rank", "id", "distance")


@query("vector_index")
def vector_index(spark, sf_dir):
    """All vectors in a stored index; every twentieth asks for its ten nearest."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = shared_folder(spark, "vectors")
    V.store(vecs, V.fit(vecs, 10), path)
    return V.search(path, vecs, vecs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), 10)


@query("mean_vector", _MEANS)
def mean_vector(spark, sf_dir):
    return mean_of_labels(spark, sf_dir)


@query("fulltext_match_rank", _text_sql(40))
def fulltext_match_rank(spark, sf_dir):
    return R.fulltext_rank(table(spark, sf_dir, "documents"), TEXT, 40)


@query(
    "fulltext_websearch",
    f"""SELECT doc_id AS id, round(ln(1.0 + len(list_filter(w, lambda x: x = 'die'))) + ln(1.0 + len(list_filter(w, lambda x: x = 'les'))) + ln(1.0 + len(list_filter(w, lambda x: x = 'reserved'))) + ln(1.0 + len(list_filter(w, lambda x: x = 'rights'))), 6) AS score
        FROM (SELECT doc_id, {_WORDS} AS w, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents)
        WHERE (contains(t, ' die ') OR contains(t, ' les ')) AND contains(t, ' rights reserved ') AND NOT contains(t, ' apache ') ORDER BY score DESC, id LIMIT 200""",
)
def fulltext_websearch(spark, sf_dir):
    return R.fulltext_rank(table(spark, sf_dir, "documents"), 'die or les "rights reserved" -apache', 200)


@query("postings", f"SELECT doc_id AS id, word, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY ALL")
def postings(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Searches of the batch: conjunctions, and one with alternatives, a phrase and an exclusion.
SEARCHES = {0: TEXT, 1: "die und", 2: "que", 3: 'die or les "rights reserved" -apache', 4: "nowhere ing", 5: "the of"}
_ALL_TERMS = {0: ("ing", "than"), 1: ("die", "und"), 2: ("que",)}
_PHRASED = f"""SELECT doc_id AS id, round({" + ".join(f"ln(1.0 + len(list_filter(w, lambda x: x = '{t}')))" for t in ("die", "les", "reserved", "rights"))}, 6) AS score
        FROM (SELECT doc_id, {_WORDS} AS w, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents)
        WHERE (contains(t, ' die ') OR contains(t, ' les ')) AND contains(t, ' rights reserved ') AND NOT contains(t, ' apache ')"""


def _searches_sql(pool: int) -> str:
    parts = [f"SELECT {q} AS query_id, * FROM ({_text_sql(pool, terms)})" for q, terms in _ALL_TERMS.items()]
    parts.append(f"SELECT 3 AS query_id, * FROM ({_PHRASED} ORDER BY score DESC, id LIMIT {pool})")
    return f"SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, score FROM ({' UNION ALL '.join(parts)})"


def searches(spark):
    return spark.createDataFrame(list(SEARCHES.items()), "query_id int, query string")


def index_of(docs):
    """Postings of the words that the searches name; a stored index holds all."""
    parsed = [R.parse_query(x) for x in SEARCHES.values()]
    return R.postings(docs, "doc_id", "text", sorted({w for q in parsed for w in [*q.words, *q.none]}))


@query("fulltext_batch", _searches_sql(40))
def fulltext_batch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.fulltext_search(index_of(docs), docs, searches(spark), 40)


@query(
    "hybrid_batch",
    f"""WITH q AS (SELECT vec_id::INTEGER AS query_id, embedding FROM embeddings WHERE vec_id < {len(SEARCHES)}),
        v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vrank FROM (SELECT q.query_id, e.vec_id AS id, {DISTANCE} AS distance FROM embeddings e, q WHERE e.embedding IS NOT NULL) QUALIFY vrank <= 40),
        t AS (SELECT query_id, id, rank AS frank FROM ({_searches_sql(40)})),
        f AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id, vrank, frank, coalesce(1.0::DOUBLE / ({R.RRF_K} + vrank), 0) + coalesce(1.0::DOUBLE / ({R.RRF_K} + frank), 0) AS score FROM v FULL OUTER JOIN t ON v.query_id = t.query_id AND v.id = t.id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, vrank::BIGINT AS vrank, frank::BIGINT AS frank, round(score, 9) AS score FROM f QUALIFY rank <= 8""",
)
def hybrid_batch(spark, sf_dir):
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    asked = searches(spark).join(vecs.select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    found = R.hybrid_search_batch(index_of(docs), docs, vecs.select(F.col("vec_id").alias("id"), "embedding"), asked)
    return found.select("query_id", "rank", "id", F.col("vrank").cast("long").alias("vrank"), F.col("frank").cast("long").alias("frank"), F.round("score", 9).alias("score"))
