"""Hybrid retrieval: vector and full-text top-k fused by reciprocal ranks.

Everything is batch-first: results carry ``query_id``; windows are partitioned by it, so
Spark keeps only a bounded number of rows a query in every task before it shuffles
(WindowGroupLimit). Text columns stay out of the ranking branches and are joined last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import words

RRF_K = 50


@dataclass(frozen=True)
class Mode:
    """How a mode retrieves: chunks fetched, chunks kept after re-ranking (None: no re-ranking)."""

    name: str
    fetch: int
    keep: int | None


MODES = {"fast": Mode("fast", 4, None), "default": Mode("default", 30, 8)}


def pool_size(k: int) -> int:
    return max(4 * k, 40)


def vector_topk(chunks: DataFrame, query_vector, k: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest chunks of one query vector, by (distance rounded to 6 places, id)."""
    q = vectors.literal(query_vector)
    scored = chunks.where(F.col(column).isNotNull()).select(F.col(id_column).alias("id"), F.round(vectors.cosine_distance(F.col(column), q), 6).alias("distance"))
    return scored.orderBy("distance", "id").limit(k)


#: Measured bytes of packed queries up to which they are broadcast; beyond, rows and query blocks are dealt to slots.
BROADCAST_BYTES = 32 << 20


def in_blocks(queries: DataFrame, rows: DataFrame, block: int = 256) -> DataFrame:
    """Each row beside each query, query blocks at a time.

    A block is one row that holds about ``block`` queries as an array. Up to ``BROADCAST_BYTES`` the blocks are broadcast and rows
    stay where they are. Beyond, rows are dealt by a hash to as many slots as there are shuffle partitions, or blocks if
    these are more, each block goes to every slot, and both meet in an equi-join on the slot: a row moves once.
    """
    packed = queries.select(F.struct(*queries.columns).alias("q"))
    n, size = packed.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json("q")))).first()
    blocks = max(1, -(-n // block))
    packed = packed.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list("q").alias("qs"))
    if (size or 0) <= BROADCAST_BYTES:
        pairs = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(packed), "block")
    else:
        slots = max(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        slot = F.pmod(F.xxhash64(*rows.columns), F.lit(slots)).cast("int")
        everywhere = packed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        pairs = rows.withColumn("slot", slot).join(everywhere, "slot")
    return pairs.select(*rows.columns, F.explode("qs").alias("q")).select(*rows.columns, "q.*")


def _nearest(queries: pa.Table, k: int):
    """Batches of (id, embedding) -> the k nearest rows of each query in a task, by a product of blocks; only these are kept while rows stream."""
    query_ids, asked = queries.column("query_id").combine_chunks(), queries.column("query_vector").to_pylist()
    by_length: dict[int, list[int]] = {}
    for q, vector in enumerate(asked):
        if vector:
            by_length.setdefault(len(vector), []).append(q)

    def run(batches):
        held = {}
        for n, some in by_length.items():
            x = np.array([asked[q] for q in some], dtype=np.float64)
            held[n] = x, np.sqrt((x**2).sum(axis=1)), [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in some]
        for batch in batches:
            lists = batch.column("embedding")
            sizes, ids = pc.list_value_length(lists).to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
            for n, (x, norms, best) in held.items():
                at = np.flatnonzero(sizes == n)
                if not len(at):
                    continue
                rows = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
                with np.errstate(all="ignore"):
                    distances = np.round(1.0 - (x @ rows.T) / (norms[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]), 6)
                for q, row in enumerate(distances):
                    d, i = best[q]
                    near = np.flatnonzero(row <= (d[-1] if len(d) == k else np.inf))  # no NaN of a zero vector
                    if len(near) > k:
                        near = near[row[near] <= np.partition(row[near], k - 1)[k - 1]]
                    d, i = np.concatenate([d, row[near]]), np.concatenate([i, ids[at[near]]])
                    first = np.lexsort((i, d))[:k]
                    best[q] = d[first], i[first]
        for n, (_, _, best) in held.items():
            for q, (d, i) in zip(by_length[n], best):
                if len(d):
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array([q] * len(d))), pa.array(i), pa.array(d)], names=["query_id", "id", "distance"])

    return run


def vector_topk_batch(chunks: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """queries (query_id, query_vector), chunks (id, embedding) -> query_id, rank, id, distance; vectors that are null, zero or of another length than the query's are not found.

    Queries of up to ``BROADCAST_BYTES`` go to the tasks, which keep k rows of each while their rows stream; beyond, rows and query blocks meet in slots.
    """
    rows = chunks.where(F.col("embedding").isNotNull() & F.col("id").isNotNull()).select("id", "embedding")
    size = queries.agg(F.sum(F.octet_length(F.to_json(F.struct("query_id", "query_vector"))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        found = _nearest(queries.select("query_id", "query_vector").toArrow(), k)
        scored = rows.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(found, f"query_id {kind(queries, 'query_id')}, id long, distance double")
        return ranked(scored.withColumn("id", F.col("id").cast(kind(chunks, "id"))), "distance", k, ascending=True)
    pairs = in_blocks(queries, rows, block)
    scored = pairs.select("query_id", "id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("query_vector")), 6).alias("distance"))
    return ranked(scored.where(F.col("distance").isNotNull()), "distance", k, ascending=True)


def ranked(scored: DataFrame, column: str, k: int, ascending: bool = False) -> DataFrame:
    """The k best rows of each query by the column, ties to the smaller id."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    window = Window.partitionBy("query_id").orderBy(order, F.col("id"))
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


@dataclass
class TextQuery:
    """A parsed search: every group of ``all`` needs one of its words, no word of ``none`` may occur."""

    all: list[list[str]] = field(default_factory=list)
    none: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)

    @property
    def words(self) -> list[str]:
        return sorted({w for g in self.all for w in g} | {w for p in self.phrases for w in p})


# English stop words of the search.
STOP_WORDS = frozenset("a an and are as at be by for from has have he in is it its of on or that the to was were will with".split())


def parse_query(text: str, stop_words=STOP_WORDS) -> TextQuery:
    """Web search syntax: words are ANDed, ``or`` joins alternatives, ``-word`` excludes, quotes make phrases."""
    out, join = TextQuery(), False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        if word == "or" and not minus:
            join = bool(out.all)
            continue
        found = [w for w in re.findall(r"[a-z0-9]+", quoted or word) if w not in stop_words]
        if minus:
            out.none += found
        elif quoted and len(found) > 1:
            out.phrases.append(found)
        elif found and join:
            out.all[-1] += found
        else:
            out.all += [[w] for w in found]
        join = False
    return out


def postings(chunks: DataFrame, id_column: str, text_column: str, wanted: list[str] | None = None, stem=None) -> DataFrame:
    """(id, word, tf), the index of ``fulltext_search``. ``wanted`` prunes the words before the shuffle; ``stem`` maps a word column to its stem."""
    each = chunks.select(F.col(id_column).alias("id"), F.explode(words(F.col(text_column))).alias("word"))
    if stem is not None:
        each = each.withColumn("word", stem(F.col("word")))
    if wanted is not None:
        each = each.where(F.col("word").isin(wanted))
    return each.groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))


def fulltext_rank(chunks: DataFrame, query: str, k: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of the k best chunks that match, by term frequencies; no inverse document frequency.

    A text is matched and scored in its own row, so nothing is shuffled before the top-k.
    """
    parsed = parse_query(query)
    text = F.concat(F.lit(" "), F.array_join(words(F.col(text_column)), " "), F.lit(" "))
    has = lambda w: F.col("__t").contains(f" {w} ")
    matched = F.lit(True)
    for group in parsed.all:
        any_of = F.lit(False)
        for w in group:
            any_of = any_of | has(w)
        matched = matched & any_of
    for phrase in parsed.phrases:
        matched = matched & has(" ".join(phrase))
    for w in parsed.none:
        matched = matched & ~has(w)
    if not parsed.words:
        matched = F.lit(False)
    tf = lambda w: F.size(F.filter(F.col("__w"), lambda x: x == w))
    score = F.lit(0.0)
    for w in parsed.words:
        score = score + F.log1p(tf(w).cast("double"))
    rows = chunks.select(F.col(id_column).alias("id"), words(F.col(text_column)).alias("__w"), text.alias("__t"))
    return rows.where(matched).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _parsed(queries: DataFrame, stop_words, stem) -> DataFrame:
    """queries (query_id, query) -> query_id, terms (word, groups, scored, banned), n_groups, phrases."""
    @F.pandas_udf("struct<terms:array<struct<word:string,groups:array<int>,scored:boolean,banned:boolean>>,n_groups:int,phrases:array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            q = parse_query(text or "", stop_words)
            groups = [*q.all, *[[w] for p in q.phrases for w in p]]
            at: dict[str, list[int]] = {w: [] for w in q.none}
            for i, g in enumerate(groups):
                for w in g:
                    at.setdefault(w, []).append(i)
            terms = [{"word": w, "groups": sorted(set(n)), "scored": bool(n), "banned": w in q.none} for w, n in at.items()]
            out.append((terms, len(groups), [" ".join(p) for p in q.phrases]))
        return pd.DataFrame(out, columns=["terms", "n_groups", "phrases"])

    rows = queries.withColumn("p", run("query")).select("query_id", "p.*")
    if stem is None:
        return rows
    return rows.withColumns(
        {
            "terms": F.transform("terms", lambda t: t.withField("word", stem(t["word"]))),
            "phrases": F.transform("phrases", lambda p: F.array_join(F.transform(F.split(p, " "), stem), " ")),
        }
    )


def fulltext_search(index: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text", stop_words=STOP_WORDS, stem=None) -> DataFrame:
    """query_id, rank, id, score of the k best chunks of each query, from a postings table (id, word, tf).

    Words meet the index by an equi-join, so texts are neither read nor split; only texts that hold all words of a phrase
    are, to confirm it. ``stem`` (word column -> stem column) must be the one that the index was made with.
    """
    parsed = _parsed(queries, stop_words, stem)
    asked = parsed.where("n_groups > 0").select("query_id", "n_groups", F.explode("terms").alias("t")).select("query_id", "n_groups", "t.*")
    if stem is not None:  # different words may share a stem
        asked = asked.groupBy("query_id", "n_groups", "word").agg(F.flatten(F.collect_list("groups")).alias("groups"), F.max("scored").alias("scored"), F.max("banned").alias("banned"))
    found = index.join(asked, "word").groupBy("query_id", "id", "n_groups").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("met"), F.max("banned").alias("banned"), F.round(F.sum(F.when(F.col("scored"), F.log1p(F.col("tf").cast("double")))), 6).alias("score")
    )
    matched = found.where((F.col("met") == F.col("n_groups")) & ~F.col("banned")).select("query_id", "id", "score")
    phrased = parsed.where(F.size("phrases") > 0).select("query_id", "phrases")
    each = words(F.col(text_column)) if stem is None else F.transform(words(F.col(text_column)), stem)
    texts = chunks.select(F.col(id_column).alias("id"), F.concat(F.lit(" "), F.array_join(each, " "), F.lit(" ")).alias("__t"))
    holds = F.forall("phrases", lambda p: F.col("__t").contains(F.concat(F.lit(" "), p, F.lit(" "))))
    confirmed = texts.join(matched.join(phrased, "query_id"), "id").where(holds).select("query_id", "id", "score")
    return ranked(matched.join(phrased, "query_id", "left_anti").unionByName(confirmed), "score", k).select("query_id", "rank", "id", "score")


def rrf_fuse(vector_ranked: DataFrame, text_ranked: DataFrame, k: float = RRF_K, keys: list[str] | None = None) -> DataFrame:
    """Both (keys, rank) -> keys, vrank, frank, score: the sum of 1 / (k + rank)."""
    keys = keys or ["id"]
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    v = vector_ranked.select(*keys, F.col("rank").alias("vrank"))
    t = text_ranked.select(*keys, F.col("rank").alias("frank"))
    return v.join(t, keys, "full_outer").withColumn("score", part("vrank") + part("frank"))


def with_rank(top: DataFrame, *order) -> DataFrame:
    """Numbers a top-k (bounded by its limit) in order."""
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def hybrid_search(chunks: DataFrame, embeddings: DataFrame, query_vector, query_text: str, k: int = 8) -> DataFrame:
    """The k best chunks of one query: id, vrank, frank, score and the chunk's columns."""
    pool = pool_size(k)
    v = with_rank(vector_topk(embeddings, query_vector, pool), "distance", "id")
    t = with_rank(fulltext_rank(chunks, query_text, pool), F.desc("score"), "id")
    fused = rrf_fuse(v, t).orderBy(F.desc("score"), "id").limit(k)
    # at most k rows
    return chunks.join(F.broadcast(fused), F.col("doc_id") == F.col("id")).orderBy(F.desc("score"), "id").limit(k)


def hybrid_search_batch(index: DataFrame, chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """queries (query_id, query, query_vector), index of ``postings``, chunks (doc_id, text), embeddings (id, embedding) -> query_id, rank, id, vrank, frank, score."""
    pool = pool_size(k)
    v = vector_topk_batch(embeddings, queries.select("query_id", "query_vector"), pool)
    t = fulltext_search(index, chunks, queries.select("query_id", "query"), pool)
    return ranked(rrf_fuse(v, t, keys=["query_id", "id"]), "score", k).select("query_id", "rank", "id", "vrank", "frank", "score")


def retrieve(chunks: DataFrame, embeddings: DataFrame, query_vector, query_text: str, mode: Mode, rerank=None) -> DataFrame:
    """A mode's retrieval; ``rerank`` maps (chunks) to the same rows with new scores."""
    found = hybrid_search(chunks, embeddings, query_vector, query_text, mode.fetch)
    if mode.keep is None:
        return found
    found = rerank(found) if rerank else found
    return found.orderBy(F.desc("score"), "id").limit(mode.keep)
