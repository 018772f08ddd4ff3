"""Operator 12: target-distribution importance resampling.

Features are runs of 1 to ``n_gram`` consecutive words, hashed by crc32 to ``BUCKETS`` buckets. A bucket's gain is the log of how much
likelier the target makes it than the source, both smoothed by one, in floored thousandths. A document's weight is the
floored mean of its features' gains; Gumbel noise drawn from its id turns the weights' order into sampling without replacement.

Plan: one pass counts the buckets of a table in arrays, a task at a time, and sums them in one aggregation (``BUCKETS`` rows a task at most).
The counts are one array of fixed length, on the driver and in the tasks. A second pass scores the documents; only
ids, counts and scores are written. The k-th best key is found by radix selection: the composite key is (score, best
first; doc_id; place), its digits of ``DIGIT`` bits are counted from the top, among the rows that share the digits found so far, so
each round is an aggregation to 2^DIGIT rows. No row is sorted for that. The rows up to the k-th key are range-partitioned,
sorted and numbered: a row's rank is its place in the partition plus the rows of the partitions before.

Edge cases: null text has no words; weight 0 without features; fewer words than ``least_words`` are scored and never drawn; null
doc_id is drawn by the empty id, after all other ids of its score; repeated rows are separate documents: equal keys are drawn in the order of the table, as many as there is room for; an empty
target or table gives gains from the smoothing alone, and an empty result; very long texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import byte_words
from .common import cut

BUCKETS, N_GRAM, LEAST_WORDS, PERCENT, SEED, DIGIT = 10_000, 1, 20, 10, 2024, 16


def buckets(words: list[bytes], n_gram: int, size: int) -> np.ndarray:
    """The bucket of each run of 1 to ``n_gram`` words."""
    runs = [zlib.crc32(w) for w in words]
    for n in range(2, n_gram + 1):
        runs += [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.array(runs, dtype=np.uint32) % size


def counts(texts: DataFrame, n_gram: int = N_GRAM, size: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts (text)."""

    def run(batches):
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held += np.bincount(buckets(byte_words(text), n_gram, size), minlength=size)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for bucket, n in found:  # at most ``size`` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares, in floored thousandths."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + size) / ((int(a) + 1) * (t + size)))) for a, b in zip(source, target)], dtype=np.int64)


def scored(docs: DataFrame, gain: np.ndarray, n_gram: int = N_GRAM, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_features, n_words, weight, score."""
    size = len(gain)

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), dtype=np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = byte_words(text)
                found = buckets(words, n_gram, size)
                out[i] = len(found), len(words), gain[found].sum() // len(found) if len(found) else 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.T.copy())], names=["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def kth_key(rows: DataFrame, columns: list[str], k: int, digit: int = DIGIT) -> list[int]:
    """The k-th smallest (from 1) of the rows' composite keys of longs, by radix selection; there are at least k rows."""
    key, sign = [], 1 << 63
    for column in columns:
        low, high = (x + sign for x in rows.agg(F.min(column), F.max(column)).first())
        unsigned = F.col(column).bitwiseXOR(F.lit(-sign))  # in the order of the longs
        top = -(-(low ^ high).bit_length() // digit) * digit
        prefix = low >> top
        for shift in range(top - digit, -1, -digit):
            here = rows if shift + digit >= 64 else rows.where(F.shiftrightunsigned(unsigned, shift + digit) == prefix)
            of = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << digit) - 1))
            for at, n in sorted(map(tuple, here.groupBy(of.alias("digit")).count().collect())):  # at most 2^digit rows
                if k <= n:
                    break
                k -= n
            prefix = prefix << digit | at
        key.append(prefix - sign)
        rows = rows.where(F.col(column) == key[-1])
    return key


def up_to(columns: list[str], key: list[int]):
    """Whether a row's composite key is at most ``key``."""
    out = F.lit(True)
    for column, value in reversed(list(zip(columns, key))):
        out = (F.col(column) < value) | ((F.col(column) == value) & out)
    return out


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with rank: 1, 2, 3... by the columns, whose values tell rows apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(parts, *columns).sortWithinPartitions(*columns))
    # read from the checkpoint, in which partitions and their order stay
    place = F.monotonically_increasing_id()
    placed = ordered.withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    before, total = {}, 0
    for part, n in sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect()):  # one row a partition
        before[part], total = total, total + n
    if not before:
        return ordered.withColumn("rank", F.lit(None).cast("long"))
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return placed.withColumn("rank", F.col("__at") + starts[F.col("__part")] + 1).drop("__part", "__at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, n_gram: int = N_GRAM, size: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, ...), target (text, ...) -> doc_id, n_features, weight, score, rank of each document; rank is null for those not drawn."""
    gain = gains(counts(docs, n_gram, size), counts(target, n_gram, size))
    rows = cut(scored(docs, gain, n_gram, seed))
    # best first; ids after their lack; the place tells equal keys apart
    rows = rows.withColumns({"__s": -F.col("score"), "__null": F.col("doc_id").isNull().cast("long"), "__id": F.coalesce("doc_id", F.lit(0)), "__place": F.monotonically_increasing_id()})
    key = ["__s", "__null", "__id", "__place"]
    may = F.col("n_words") >= least_words
    k = rows.where(may).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*out)
    drawn = may & up_to(key, kth_key(rows.where(may), key, k))
    best = numbered(rows.where(drawn), key)
    return best.select(*out).unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*out))
