"""Statistical language detection: a naive Bayes model of character trigrams.

``fit`` counts the trigrams of texts of known language; the ``grams`` most frequent of each language make
the model, a table of (gram, language, weight). ``detect`` joins a text's trigrams to it: the language of the largest sum of log
likelihoods wins, and the confidence is its share against the second. A text's trigrams are counted in its own task before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import analysis

GRAMS = 3000
#: Letters that a task counts at once, and counters up to which it counts without sorting.
LETTERS, COUNTERS = 1_000_000, 1 << 23


def letters(text: Column) -> Column:
    """The lower-case letters of a text, words parted by single spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([\x{10000}-\x{10FFFF}]|[^\p{L}])+", " ")


def _counts(texts: list[str], groups: np.ndarray):
    """(group, trigram, count) arrays of texts, whose groups are small whole numbers."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    alphabet = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
    of = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int64)
    of[alphabet] = np.arange(len(alphabet))
    at, k = of[codes], len(alphabet)
    inside = np.ones(len(codes), dtype=bool)  # a trigram starts where two letters of the same text follow
    ends = np.cumsum(sizes)
    for back in (1, 2):
        inside[np.maximum(ends[sizes >= back] - back, 0)] = False
    starts = np.flatnonzero(inside)
    keys = ((np.repeat(groups, sizes)[starts] * k + at[starts]) * k + at[starts + 1]) * k + at[starts + 2]
    top = (int(groups.max()) + 1) * k**3 if len(groups) else 0
    if top <= COUNTERS:
        n = np.bincount(keys)
        keys = np.flatnonzero(n)
        n = n[keys]
    else:
        keys, n = np.unique(keys, return_counts=True)
    rest = max(k, 1)
    parts = [alphabet[keys // rest**i % rest] if k else keys for i in (2, 1, 0)]
    joined = np.stack(parts, axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return keys // rest**3, [joined[i : i + 3] for i in range(0, len(joined), 3)], n


def trigram_counts(texts: DataFrame, keys: list[str], pooled: bool = False) -> DataFrame:
    """texts (keys, text) -> keys, gram, n: the trigrams of each text's ``letters``, counted where the text is. ``pooled``: texts of equal keys (one column) are counted together as far as they meet."""

    def run(batches):
        for batch in batches:
            if pooled:
                coded = batch.column(0).dictionary_encode()
                groups, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [coded.dictionary]
            else:
                groups, names = np.arange(batch.num_rows, dtype=np.int64), batch.columns[: len(keys)]
            plain = batch.column(len(keys)).to_pylist()
            parts = np.cumsum(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))) // LETTERS
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(plain)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                low = 0 if pooled else a
                group, grams, n = _counts(plain[a:b], groups[a:b] - low)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(group + low)) for c in names], pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=[*keys, "gram", "n"])

    chosen = texts.select(*keys, letters(F.col("text")).alias("letters"))
    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[: len(keys)])
    return chosen.mapInArrow(run, f"{schema}, gram string, n long").groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, grams: int = GRAMS) -> DataFrame:
    """texts (lang, text) -> model (gram, lang, weight, unseen): log shares of a language's trigrams, smoothed by one half, and that of a gram it lacks.

    At most ``grams`` rows a language; null languages teach nothing.
    """
    counted = trigram_counts(texts.where("lang IS NOT NULL"), ["lang"], pooled=True)
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= grams).drop("place")
    kept = top.select("gram").distinct()
    # every kept gram's count in every language, also where it is not among the most frequent
    known = counted.join(kept, "gram")
    total = known.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("size", F.lit(grams))
    share = lambda n: F.log((n + F.lit(0.5)) / (F.col("total") + F.lit(0.5) * F.col("size")))
    return known.join(F.broadcast(total), "lang").select("gram", "lang", share(F.col("n")).alias("weight"), share(F.lit(0)).alias("unseen"))


def detect(texts: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """texts (keys, text) -> keys, language, confidence; texts without a known trigram get no row. ``keys`` tell the texts apart."""
    counted = trigram_counts(texts, keys)
    # above what the language gives a gram that it lacks; that part is the same for all grams of a text
    gains = F.broadcast(model.groupBy("gram").agg(F.collect_list(F.struct("lang", (F.col("weight") - F.col("unseen")).alias("gain"))).alias("gains")))  # at most ``GRAMS`` a language
    base = model.groupBy().agg(F.collect_set(F.struct("lang", "unseen")).alias("base"))
    met = counted.join(gains, "gram").select(*keys, "n", F.explode("gains").alias("g")).groupBy(*keys, "g.lang").agg(F.sum(F.col("n") * F.col("g.gain")).alias("gain"))
    size = counted.join(gains.select("gram"), "gram").groupBy(*keys).agg(F.sum("n").alias("known"))
    languages = base.select(F.explode("base").alias("b")).select("b.lang", "b.unseen")
    scored = met.join(F.broadcast(languages), "lang").join(size, keys).withColumn("score", F.col("gain") + F.col("known") * F.col("unseen"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("loss"), F.col("lang").alias("language"))))
    best = scored.groupBy(*keys, "known").agg(order.alias("best"))
    margin = F.coalesce(F.get("best", F.lit(1))["loss"] - F.get("best", F.lit(0))["loss"], F.lit(30.0))
    return best.select(*keys, F.get("best", F.lit(0))["language"].alias("language"), (1 / (1 + F.exp(-F.least(margin, F.lit(30.0))))).alias("confidence"))


def language(texts: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """texts (keys, text) -> keys, language, confidence: by the markers, and by the model only where these are even."""
    found = texts.join(detect(texts, model, keys).withColumnRenamed("language", "__l").withColumnRenamed("confidence", "__c"), keys, "left")
    detector = F.struct(F.col("__l").alias("language"), F.coalesce("__c", F.lit(0.0)).alias("confidence"))
    decided = found.select(*keys, analysis.language(F.col("text"), detector).alias("d"))
    return decided.select(*keys, "d.language", "d.confidence")
