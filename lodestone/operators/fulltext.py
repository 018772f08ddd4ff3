"""Positional full-text search over a stored index.

Index: a row for each stem of a document, with the ascending positions (from 1, stop words counted) at which it stands. It is
stored in hash buckets of (stem, part); ``part`` deals the documents of a stem to ``PARTS`` buckets, so that a frequent stem is no
hot key. Rows of one id are one document, positions of all its rows fall together; null ids are kept. A search reads the rows of its stems and never a text: phrases are confirmed from positions.

Search syntax: words are ANDed, ``or`` joins alternatives and binds weaker than AND, quotes make phrases, ``-`` excludes a word or
phrase. Stop words drop out but keep their place in a phrase. An alternative without a word to look for finds nothing.

Rank: of a search without ``or``, each two of its stems that stand at a distance d of at most ``REACH`` add
sqrt(w * w * f(d)), f(d) = 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)), w = ``WEIGHT``, as independent chances. With ``or``, or one
stem, it is the mean over the stems of w times the sum of 1/j^2 over their occurrences, divided by pi^2/6. Positions count without a bound.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stem_of, with_stem
from ..sources.stored import open_bucketed, save_bucketed
from .retrieval import ranked

WEIGHT, REACH, SUM_OF_SQUARES = 0.1, 100, 1.64493406685
PARTS = 8
#: Measured rows of (search, stem) up to which searches are broadcast; beyond, they are dealt to the index's buckets.
BROADCAST_ROWS = 100_000
#: Words that a task packs at a time (one document may have more), and stems that it remembers.
WORDS, REMEMBERED = 2_000_000, 500_000
INDEX = "stem string, part int, id long, positions array<int>"

# English stop words of the full-text configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

_WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """All words in lower case, in order, as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _held(pieces: list[pa.RecordBatch], remembered: dict[str, str], stop_words: frozenset[str]):
    """Batches (id, part, words) -> batches of INDEX, sorted by stem and part."""
    ids, parts, lists = (pa.concat_arrays([p.column(i) for p in pieces]) for i in range(3))
    sizes, coded = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()
    if len(remembered) > REMEMBERED:
        remembered.clear()
    names: dict[str, int] = {}
    code_of = np.empty(len(coded.dictionary), np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        if word in stop_words:
            code_of[i] = -1
            continue
        if (stem := remembered.get(word)) is None:
            stem = remembered[word] = stem_of(word)
        code_of[i] = names.setdefault(stem, len(names))
    code = code_of[coded.indices.to_numpy(zero_copy_only=False)]
    kept = np.flatnonzero(code >= 0)
    if not len(kept):
        return
    document = np.repeat(np.arange(len(sizes)), sizes)
    at = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1)[kept].astype(np.int32)
    code, document = code[kept], document[kept]
    key = (code * PARTS + parts.to_numpy(zero_copy_only=False)[document]) * len(sizes) + document
    order = np.argsort(key, kind="stable")  # positions keep their order
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # of each stem of a document
    row, document = np.divmod(key[first], len(sizes))
    columns = [
        pa.array(list(names), pa.string()).take(pa.array(row // PARTS)),
        pa.array((row % PARTS).astype(np.int32)),
        ids.take(pa.array(document)),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(at[order])),
    ]
    yield from pa.table(columns, names=["stem", "part", "id", "positions"]).to_batches(max_chunksize=100_000)


def _each(texts: DataFrame, stop_words) -> DataFrame:
    """texts (id, text) -> INDEX of each text, made where it is read: nothing is shuffled, and a different word is stemmed once a run of texts at most."""
    stops = frozenset(stop_words or ())

    def run(batches):
        remembered, pieces, size = {}, [], 0
        for batch in batches:
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + WORDS - size, "right")))
                pieces.append(batch.slice(a, b - a))
                size += int(ends[b - 1]) - done
                if size >= WORDS or b < batch.num_rows:
                    yield from _held(pieces, remembered, stops)
                    pieces, size = [], 0
                a = b
        if pieces:
            yield from _held(pieces, remembered, stops)

    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    return texts.select("id", part.alias("part"), tokens(F.col("text")).alias("words")).mapInArrow(run, INDEX)


def _merged(each: DataFrame) -> DataFrame:
    """Rows of one id are one document."""
    return each.groupBy("stem", "part", "id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def _texts(chunks: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """(id, text) of the chunks, and whether an id repeats; only ids are shuffled for that."""
    texts = chunks.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return texts, not texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def postings(chunks: DataFrame, id_column: str = "doc_id", text_column: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """INDEX of the chunks. Nothing is shuffled but ids, and the rows if ids repeat."""
    texts, repeats = _texts(chunks, id_column, text_column)
    each = _each(texts, stop_words)
    return _merged(each).select("stem", "part", "id", "positions") if repeats else each


def store_index(chunks: DataFrame, path: str, buckets: int = 64, id_column: str = "doc_id", text_column: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """Write the index of the chunks to a folder; the stored table. Its rows are shuffled once, to their buckets, packed unless ids repeat."""
    texts, repeats = _texts(chunks, id_column, text_column)
    return save_bucketed(_each(texts, stop_words), path, ["stem", "part"], buckets, _merged if repeats else None)


def open_index(spark, path: str, buckets: int = 64) -> DataFrame:
    return open_bucketed(spark, path, INDEX, ["stem", "part"], buckets)


def parse_search(text: str | None, stop_words=frozenset(STOP_WORDS)) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """Alternatives; each a list of (banned, words of the unit with their offsets)."""
    out: list[list] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', (text or "").lower()):
        if plain == "or" and not minus:
            out.append([])
            continue
        words = [(w, i) for i, w in enumerate(re.findall(r"[^\W_]+", quoted or plain)) if w not in stop_words]
        if words:
            out[-1].append((bool(minus), [(w, i - words[0][1]) for w, i in words]))
    return [a for a in out if any(not banned for banned, _ in a)]


PARSED = "array<struct<alternative:int,unit:int,banned:boolean,word:string,offset:int>>"


def parsed(searches: DataFrame) -> DataFrame:
    """searches (query_id, query) -> a row for each word: query_id, alternative, unit, banned, word, offset, stem, n_alternatives."""

    @F.pandas_udf(PARSED)
    def run(texts: pd.Series) -> pd.Series:
        rows = lambda t: [{"alternative": a, "unit": u, "banned": b, "word": w, "offset": o} for a, units in enumerate(parse_search(t)) for u, (b, words) in enumerate(units) for w, o in words]
        return texts.map(rows)

    found = searches.select("query_id", run("query").alias("p")).withColumn("n_alternatives", 1 + F.coalesce(F.array_max(F.transform("p", lambda x: x["alternative"])), F.lit(-1)))
    return with_stem(found.select("query_id", "n_alternatives", F.explode("p").alias("x")).select("query_id", "n_alternatives", "x.*"))


def _structure(words: DataFrame) -> DataFrame:
    """A row a search: alternatives (arrays of units, a unit banned and its words) and the number of its stems."""
    units = words.groupBy("query_id", "n_alternatives", "alternative", "unit", "banned").agg(F.array_sort(F.collect_list(F.struct("offset", "stem"))).alias("words"))
    alternatives = units.groupBy("query_id", "n_alternatives", "alternative").agg(F.collect_list(F.struct("banned", "words")).alias("units"))
    shape = alternatives.groupBy("query_id", "n_alternatives").agg(F.collect_list("units").alias("alternatives"))
    return shape.join(words.groupBy("query_id").agg(F.count_distinct("stem").alias("n_stems")), "query_id")


def _stands(unit: Column) -> Column:
    """Whether a unit's words stand one after another at their offsets, from the positions in ``held``."""
    of = lambda word: F.coalesce(F.try_element_at(F.col("held"), word["stem"]), F.array().cast("array<int>"))
    words = unit["words"]
    start = of(F.get(words, F.lit(0)))
    return F.exists(start, lambda p: F.forall(words, lambda w: F.array_contains(of(w), p + w["offset"])))


def _near() -> Column:
    """Rank of a search without alternatives: 1 - the product of (1 - chance) over all near pairs of different stems."""
    entries = F.array_sort(F.flatten(F.transform(F.map_entries("held"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("stem"))))))

    def chances(all_of):
        def of(x, i):
            ahead = F.filter(F.slice(all_of, i + F.lit(2), F.lit(REACH)), lambda y: (y["at"] - x["at"] <= REACH) & (y["stem"] != x["stem"]))
            chance = lambda y: WEIGHT * F.sqrt(1 / (1.005 + 0.05 * F.exp((y["at"] - x["at"]) / F.lit(1.5) - 2)))
            return F.aggregate(ahead, F.lit(0.0), lambda s, y: s + F.log1p(-chance(y)))

        return F.aggregate(F.transform(all_of, of), F.lit(0.0), lambda s, x: s + x)

    # bound once: the entries are an array of one element
    logs = F.get(F.transform(F.array(entries), chances), F.lit(0))
    return F.lit(1.0) - F.exp(logs)


def _often() -> Column:
    """Rank of a search with alternatives or of one stem: the mean of the stems' damped counts."""
    of = lambda n: F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (j * j))
    total = F.aggregate(F.map_values("held"), F.lit(0.0), lambda s, p: s + of(F.size(p)))
    return F.lit(WEIGHT) * total / F.lit(SUM_OF_SQUARES) / F.col("n_stems")


def search(index: DataFrame, searches: DataFrame, k: int) -> DataFrame:
    """searches (query_id, query) -> query_id, rank, id, score of the k best documents of each, ties to the smaller id."""
    words = parsed(searches)
    stems = words.select("query_id", "stem").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    if stems.count() <= BROADCAST_ROWS:
        stems = F.broadcast(stems)
    held = index.join(stems, ["stem", "part"]).groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("stem", "positions"))).alias("held"))
    found = held.join(_structure(words), "query_id")
    matched = found.where(F.exists("alternatives", lambda units: F.forall(units, lambda u: _stands(u) != u["banned"])))
    score = F.when((F.col("n_alternatives") == 1) & (F.col("n_stems") > 1), _near()).otherwise(_often())
    return ranked(matched.select("query_id", "id", F.round(score, 6).alias("score")), "score", k).select("query_id", "rank", "id", "score")
