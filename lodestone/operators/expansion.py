"""Query expansion: a model's paraphrases are searched beside the query, and the results fused by rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analysis import paraphrases
from .retrieval import RRF_K, ranked

#: Paraphrases of a query that are searched.
CAP = 3


def variants(queries: DataFrame, ask: Callable[[Column], Column], cap: int = CAP) -> DataFrame:
    """queries (query_id, query) -> query_id, variant (0: the query itself), query. ``ask``: query column -> column of the model's answer, a line a paraphrase.

    A paraphrase that says the query again, whatever its case, is left out; without an answer only the query stays.
    """
    more = F.filter(paraphrases(ask(F.col("query")), cap + 1), lambda p: F.lower(p) != F.lower(F.col("query")))
    return queries.select("query_id", F.posexplode(F.concat(F.array("query"), F.slice(more, 1, cap))).alias("variant", "query"))


def expanded_search(queries: DataFrame, ask: Callable[[Column], Column], search: Callable[[DataFrame, int], DataFrame], k: int, cap: int = CAP, rrf_k: float = RRF_K) -> DataFrame:
    """query_id, rank, id, score (the sum of 1 / (rrf_k + rank) over the variants that find it), variants (how many do).

    ``search``: (searches (query_id, query), pool size) -> (query_id, rank, id, ...), all variants in one batch.
    """
    asked = variants(queries, ask, cap)
    named = asked.select(F.concat_ws("#", "variant", F.col("query_id").cast("string")).alias("name"), "query_id", "query")
    found = search(named.select(F.col("name").alias("query_id"), "query"), max(2 * k, 40)).withColumnRenamed("query_id", "name").select("name", "rank", "id")
    fused = found.join(named.select("name", "query_id"), "name").groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(float(rrf_k)) + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("variants"))
    return ranked(fused, "score", k).select("query_id", "rank", "id", "score", "variants")
