"""Operator 2: exact top-k by inner product with vector-approximation files.

Vectors become integers, floor(scale * x). A block of candidates keeps them twice, in columns of their own: as
an approximation file of one signed byte a component (the cell it falls in), made once when the block is packed,
and exactly. A query scans the cells, in single precision where that is exact, for an upper and a lower bound of each inner product, then reads
exact vectors in order of their bounds until the k-th best exact score is certain: no
vector left has an upper bound that reaches it. Of the exact column only these rows are touched.

Plan: candidates and queries are packed to blocks of bounded size in place, and every
query block meets every candidate block (the stated query set against all rows, in
blocks). If the queries' measured size is under ``BROADCAST_BYTES`` they are broadcast
and candidates never move; else both sides are dealt to slots of about one candidate block,
each query block to every slot, and joined on the slot. Each meeting yields at most
k rows a query, merged by a bounded top-k a query. Exact copies of a vector within a block beyond
the k+1 smallest ids cannot be among the k best, and are left out there.

Integers: scores are computed in double precision where all sums stay below 2**53 and in
Python integers else; a score outside 64 bits raises.

Edge cases: null vectors and vectors with null or non-finite components take no part; an
empty vector scores 0; vectors only meet others of their length; ties go to the
smaller id; a query's own id is no candidate, also when rows repeat (repeated candidate rows
are ranked each); a repeated query row (same id and vector) is asked once; null ids take no part; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE, BLOCK, QUERY_BLOCK, BROADCAST_BYTES = 10, 1024, 16384, 1024, 32 << 20

PACKED = "size int, n long, ids binary, whole binary"
#: Sums of integers up to here are exact in single and in double precision.
SINGLE, DOUBLE = 2**24, 2**53


def valid(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose id is known and whose vector is there and finite throughout."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)))


def pack_blocks(df: DataFrame, rows: int, scale: int | None = SCALE, copies: int | None = None) -> DataFrame:
    """df (vec_id, embedding) -> blocks of at most ``rows`` vectors of one length, made in
    place. copies: of equal vectors of a block, as many with the smallest ids stay."""

    def run(batches):
        held: dict[int, list] = {}

        def block(size):
            ids = np.concatenate([x for x, _ in held[size]])
            whole = np.concatenate([x for _, x in held[size]])
            held[size] = []
            if copies:
                ids, whole = least_copies(ids, whole, copies)
            for at in range(0, len(ids), rows):
                part = whole[at : at + rows]
                yield size, len(part), ids[at : at + rows].astype("<i8").tobytes(), np.ascontiguousarray(part, "<f8").tobytes()

        def out(blocks):
            size, n, ids, whole = zip(*blocks)
            return pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(whole, pa.binary())], names=["size", "n", "ids", "whole"])

        for batch in batches:
            lists = batch.column("embedding")
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            offsets = offsets[:-1] - offsets[0]
            if scale:
                flat = np.floor(flat * scale)
            for size in np.unique(lengths):
                of = lengths == size
                at = offsets[of][:, None] + np.arange(size)[None, :]
                held.setdefault(int(size), []).append((ids[of], flat[at] if size else np.empty((of.sum(), 0))))
                if sum(len(x) for x, _ in held[int(size)]) >= rows:
                    yield out(list(block(int(size))))
        for size in list(held):
            if held[size]:
                yield out(list(block(size)))

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, PACKED)


def _matrix(ids: bytes, whole: bytes, size: int):
    n = np.frombuffer(ids, "<i8")
    return n, np.frombuffer(whole, "<f8").reshape(len(n), size)


def least_copies(ids: np.ndarray, rows: np.ndarray, copies: int):
    """Leave of equal rows those with the ``copies`` smallest different ids, each at most ``copies`` times."""
    kind = np.zeros(len(ids), dtype=np.int64)
    if rows.shape[1]:
        _, kind = np.unique(rows.view([("", rows.dtype)] * rows.shape[1]).ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    other = np.concatenate(([True], np.diff(kind[order]) != 0))[: len(order)]
    fresh = other | np.concatenate(([True], np.diff(ids[order]) != 0))[: len(order)]
    run = np.cumsum(fresh)
    nth = run - np.maximum.accumulate(np.where(other, run, 0))  # of the different ids of equal rows
    again = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    stay = np.sort(order[(nth < copies) & (again < copies)])
    return ids[stay], rows[stay]


class ApproximationFile:
    """Integer vectors as one byte a component, with bounds of inner products."""

    def __init__(self, rows: np.ndarray, cells: np.ndarray, width: float):
        self.rows, self.cells, self.width = rows, cells, width
        self.most = width * (np.abs(cells.astype(np.float64)).max(initial=0) + 1)

    @classmethod
    def of(cls, rows: np.ndarray) -> ApproximationFile:
        most = np.abs(rows).max(initial=0)
        width = 2.0 ** max(0, int(np.ceil(np.log2(most + 1))) - 7) if most else 1.0
        return cls(rows, np.clip(np.floor(rows / width), -128, 127).astype(np.int8), width)

    def exact(self, query: np.ndarray) -> bool:
        """Whether double precision holds every sum."""
        return np.abs(query).max(initial=0) * self.most * max(1, query.shape[-1]) < DOUBLE

    def bounds(self, queries: np.ndarray):
        """(lower, upper) of queries x rows. A row lies in [cell, cell + 1) * width, so at most width - 1 above."""
        kind = np.float32 if np.abs(queries).max(initial=0) * 128 * max(1, queries.shape[1]) < SINGLE else np.float64
        least = (queries.astype(kind) @ self.cells.T.astype(kind)).astype(np.float64) * self.width
        slack = self.width - 1
        return least + slack * np.minimum(queries, 0).sum(axis=1)[:, None], least + slack * np.maximum(queries, 0).sum(axis=1)[:, None]


def _exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if np.abs(query).max(initial=0) * np.abs(rows).max(initial=0) * max(1, len(query)) < DOUBLE:
        return (rows @ query).astype(np.int64)
    wide = [sum(int(a) * int(b) for a, b in zip(query, row)) for row in rows]
    return np.array(wide, dtype=np.int64)  # raises if a score needs more than 64 bits


def search(file: ApproximationFile, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query_id, vec_id, score) of each query's k best in the file, some more on ties of bounds."""
    out = []
    # rounding of sums beyond 2**53 is far below this share of their size
    exact_bounds = file.exact(queries)
    for at in range(0, len(queries), 128):
        some = queries[at : at + 128]
        lower, upper = file.bounds(some)
        if not exact_bounds:
            slip = 1e-9 * (np.abs(some).sum(axis=1)[:, None] * file.most + 1)
            lower, upper = lower - slip, upper + slip
        own = query_ids[at : at + 128, None] == ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        n = min(k, len(ids))
        floor = np.partition(lower, len(ids) - n, axis=1)[:, len(ids) - n]  # the k-th largest lower bound
        for q in range(len(some)):
            order = np.flatnonzero((upper[q] >= floor[q]) & ~own[q])
            order = order[np.argsort(-upper[q][order], kind="stable")]
            best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
            for step in range(0, len(order), 4 * k):  # exact vectors, a few at a time, by their bounds
                part = order[step : step + 4 * k]
                if len(best) >= k and upper[q][part[0]] < best[-1]:
                    break
                best_ids, best = np.concatenate((best_ids, ids[part])), np.concatenate((best, _exact(some[q], file.rows[part])))
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
            out.append((np.full(len(best), query_ids[at + q]), best_ids, best))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def with_cells(blocks: DataFrame) -> DataFrame:
    """Blocks with their approximation file: the columns cells and width."""

    def run(batches):
        for batch in batches:
            found = [ApproximationFile.of(_matrix(ids, whole, size)[1]) for size, ids, whole in zip(*[batch.column(c).to_pylist() for c in ("size", "ids", "whole")])]
            columns = [pa.array([f.cells.tobytes() for f in found], pa.binary()), pa.array([f.width for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "cells", "width"])

    return blocks.mapInArrow(run, PACKED + ", cells binary, width double")


def meet(queries: DataFrame, candidates: DataFrame, query_bytes: int, slots: int) -> DataFrame:
    """Each query block beside each candidate block of the same vector length."""
    q = queries.select("size", F.col("ids").alias("q_ids"), F.col("whole").alias("q_whole"))
    c = candidates.select("size", "ids", "whole", "cells", "width")
    if query_bytes <= BROADCAST_BYTES:
        return c.join(F.broadcast(q), "size")
    c = c.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    q = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return q.join(c, ["size", "slot"])


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors, queries (vec_id, embedding, ...) -> query_id, rank, vec_id, score."""

    def run(batches):
        for batch in batches:
            for size, q_ids, q_whole, ids, whole, cells, width in zip(*[batch.column(c).to_pylist() for c in ("size", "q_ids", "q_whole", "ids", "whole", "cells", "width")]):
                n, rows = _matrix(ids, whole, size)
                file = ApproximationFile(rows, np.frombuffer(cells, np.int8).reshape(len(n), size), width)
                found = search(file, n, *_matrix(q_ids, q_whole, size), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    queries, vectors = valid(queries).dropDuplicates(["vec_id", "embedding"]), valid(vectors)
    query_bytes = 8 * (queries.agg(F.sum(F.size("embedding") + 1)).first()[0] or 0)
    slots = 1
    if query_bytes > BROADCAST_BYTES:
        slots = max(queries.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // block))
    pairs = meet(pack_blocks(queries, query_block, scale), with_cells(pack_blocks(vectors, block, scale, k + 1)), query_bytes, slots)
    return best(pairs.mapInArrow(run, "query_id long, vec_id long, score long"), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
