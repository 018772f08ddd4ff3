"""Operator 6: approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` rows in expectation, dealt by a hash of
the id) and every row is then put in a leaf. A query walks the tree best-bin-first:
a priority queue of open branches, nearest centre first, until it has visited as many
leaves as calibration asks for. Calibration widens the visits until sampled queries,
against brute force over the sample, reach ``RECALL``; visiting all leaves is exact, so
the target can always be reached.

Plan: the sample and the tree are bounded by parameters (the tree goes to the tasks in
their closure). Between ``SAMPLE`` and ``SAMPLE_MOST`` the sample grows with the root of the rows, and with it the number of leaves, so
a leaf of a larger table is a smaller share of it. Rows are packed with their leaves in place, queries with a bit for each leaf
they visit. A task turns these bits round, to the queries of each leaf (inverted lists), and multiplies a leaf's
rows by these queries only; ``scored`` counts such pairs. If the queries' measured size is
under ``BROADCAST_BYTES`` they are broadcast and rows never move. Else rows are dealt to slots
of neighbouring leaves, each query block goes to the slots it visits, and both meet in
an equi-join on the slot. A crowded leaf is many blocks, so it can be split; of
equal vectors in a block only the k+1 smallest different ids can matter and only they are kept. Each
task merges its finds to the k best a query before they are shuffled.

Scores are inner products in double precision of the original vectors, summed in the same
order for equal vectors, so ties are exact and go to the smaller id.

Edge cases: null, zero and empty vectors and those with null or non-finite components take
no part, nor do null ids; vectors only meet others of their length, and those of another
length than the most common in the sample are searched whole; very long vectors only make the sample smaller; other columns are ignored, whatever their names; a query's own id
is no candidate; a repeated query row (same id and vector) is asked once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_topk import BROADCAST_BYTES, best, least_copies, pack_blocks, valid

K, SAMPLE, SAMPLE_MOST, BRANCH, LEAF_SAMPLE, RECALL, TRIALS, BLOCK, QUERY_BLOCK = 20, 16384, 262_144, 16, 64, 0.95, 200, 16384, 1024
MERGE_ROWS = 400_000
#: Bytes of sampled vectors that the driver fits the tree on.
SAMPLE_BYTES = 128 << 20
#: Numbers that are multiplied at once when finds are scored exactly.
PAIR_VALUES = 1 << 22
#: One of so many rows of a block gives a query's first floor.
FLOOR_STEP = 16


def kmeans(rows: np.ndarray, k: int, rng, rounds: int = 8):
    """(centres, label of each row), empty clusters dropped."""
    centres = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        label = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, rows)
        n = np.bincount(label, minlength=len(centres))
        centres = sums[n > 0] / n[n > 0, None]
    return centres, nearest(rows, centres)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T, axis=1)


class Tree:
    """Nodes hold (centres, children); a child is a node's index, or a leaf as ~leaf."""

    def __init__(self, rows: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_SAMPLE, seed: int = 0):
        self.nodes: list = []
        self.leaves, self.size = 0, rows.shape[1] if len(rows) else -1
        self._grow(rows, branch, leaf_rows, np.random.default_rng(seed))

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def _grow(self, rows, branch, leaf_rows, rng) -> int:
        if len(rows) <= leaf_rows:
            return self._leaf()
        centres, label = kmeans(rows, branch, rng)
        if len(centres) < 2 or np.bincount(label).max() == len(rows):
            return self._leaf()
        at = len(self.nodes)
        self.nodes.append(None)
        children = [self._grow(rows[label == c], branch, leaf_rows, rng) for c in range(len(centres))]
        self.nodes[at] = (centres, children)
        return at

    def assign(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int32)
        todo = [(0, np.arange(len(rows)))] if self.nodes else []
        while todo:
            node, of = todo.pop()
            centres, children = self.nodes[node]
            label = nearest(rows[of], centres)
            for c, child in enumerate(children):
                part = of[label == c]
                if len(part) and child < 0:
                    out[part] = ~child
                elif len(part):
                    todo.append((child, part))
        return out

    def visit(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that a best-bin-first walk reaches."""
        if not self.nodes:
            return [0]
        heap, out = [(0.0, 0)], []
        while heap and len(out) < leaves:
            _, at = heapq.heappop(heap)
            if at < 0:
                out.append(~at)
                continue
            centres, children = self.nodes[at]
            for p, child in zip((-(centres @ query)).tolist(), children):
                heapq.heappush(heap, (p, child))
        return out

    def calibrate(self, rows: np.ndarray, k: int, recall: float, trials: int) -> int:
        """The fewest visits that find ``recall`` of the true k best of sampled queries."""
        if self.leaves < 2:
            return 1
        leaf, found = self.assign(rows), np.zeros(self.leaves)
        picked = np.linspace(0, len(rows) - 1, min(trials, len(rows))).astype(int)
        for q in picked:
            scores = rows @ rows[q]
            scores[q] = -np.inf
            true = np.argpartition(-scores, min(k, len(rows) - 1) - 1)[: min(k, len(rows) - 1)]
            place = np.empty(self.leaves, dtype=int)
            place[self.visit(rows[q], self.leaves)] = np.arange(self.leaves)
            found += np.bincount(place[leaf[true]], minlength=self.leaves) / len(true)
        reached = np.cumsum(found) / len(picked)
        return int(min(self.leaves, np.searchsorted(reached, recall) + 1))


def _vectors(ids: bytes, whole: bytes, size: int):
    ids = np.frombuffer(ids, "<i8")
    rows = np.frombuffer(whole, "<f8").reshape(len(ids), size)
    some = (rows != 0).any(axis=1)
    return ids[some], rows[some]


def _batch(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), schema)], names=[n for n, _ in schema])


_PLACED = [("size", pa.int32()), ("slot", pa.int32()), ("leaves", pa.binary()), ("ids", pa.binary()), ("whole", pa.binary())]
_ASKED = [("size", pa.int32()), ("slots", pa.list_(pa.int32())), ("q_ids", pa.binary()), ("q_whole", pa.binary()), ("visits", pa.binary())]


def _placed(tree: Tree, slots: int, copies: int):
    """Blocks of rows with their leaves, split by slot: neighbouring leaves share one."""

    def run(batches):
        for batch in batches:
            for size, raw, whole in zip(*[batch.column(c).to_pylist() for c in ("size", "ids", "whole")]):
                ids, rows = least_copies(*_vectors(raw, whole, size), copies)
                leaves = tree.assign(rows) if size == tree.size else np.zeros(len(ids), np.int32)
                slot = leaves.astype(np.int64) * slots // max(1, tree.leaves)
                order = np.lexsort((ids, leaves))
                out = []
                for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
                    if len(part):
                        out.append((size, int(slot[part[0]]), leaves[part].astype("<i4").tobytes(), ids[part].astype("<i8").tobytes(), np.ascontiguousarray(rows[part], "<f8").tobytes()))
                if out:
                    yield _batch(out, _PLACED)

    return run


def _asked(tree: Tree, visits: int, slots: int):
    """Blocks of queries with the leaves each one visits, as bits, and the slots that holds any."""

    def run(batches):
        for batch in batches:
            for size, raw, whole in zip(*[batch.column(c).to_pylist() for c in ("size", "ids", "whole")]):
                ids, rows = _vectors(raw, whole, size)
                if not len(ids):
                    continue
                visited = np.zeros((len(ids), max(1, tree.leaves)), dtype=bool)
                if size == tree.size:
                    for q, row in enumerate(rows):
                        visited[q, tree.visit(row, visits)] = True
                else:
                    visited[:] = True
                held = sorted({int(x) * slots // max(1, tree.leaves) for x in np.flatnonzero(visited.any(axis=0))})
                yield _batch([(size, held, ids.astype("<i8").tobytes(), np.ascontiguousarray(rows, "<f8").tobytes(), np.packbits(visited, axis=1).tobytes())], _ASKED)

    return run


def keep_best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int, names: np.ndarray | None = None):
    """The k best of each query by (score, vec_id); names: the queries' ids, if ``query`` has their places."""
    order = np.lexsort((vec, -score, query))
    starts = np.flatnonzero(np.concatenate(([True], np.diff(query[order]) != 0)))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[place < k]
    return query[order] if names is None else names[query[order]], vec[order], score[order]


def _scored(k: int, leaves: int):
    leaves = max(1, leaves)

    def near(q, q_rows, visited, ids, rows, leaf):
        """Of each query: the k best rows in the leaves it visits, with scores summed alike for equal rows."""
        starts = np.flatnonzero(np.concatenate(([True], np.diff(leaf) != 0)))  # rows are in order of their leaves
        norms, widest = np.linalg.norm(q_rows, axis=1), np.linalg.norm(rows, axis=1).max()
        # Products differ from the exact scores in their last bits: all rows that rounding could lift to the k-th place stay.
        margin = 4 * (rows.shape[1] + 2) * np.finfo(float).eps * norms * widest
        # The k-th best product among some rows is a floor for that among all, and spares most pairs the sorting below.
        floor, some = np.full(len(q), -np.inf), slice(None, None, FLOOR_STEP)
        if len(ids[some]) > k:
            first = q_rows @ rows[some].T
            first[~visited[:, leaf[some]] | (q[:, None] == ids[None, some])] = -np.inf
            floor = np.partition(first, first.shape[1] - k, axis=1)[:, first.shape[1] - k]
        least = floor - margin
        places, at, products = [], [], []
        for first, last in zip(starts, np.append(starts[1:], len(leaf))):
            asks = np.flatnonzero(visited[:, leaf[first]])
            if not len(asks):
                continue
            scores = q_rows[asks] @ rows[first:last].T
            row, col = np.nonzero(scores >= least[asks][:, None])
            other = q[asks[row]] != ids[first + col]
            row, col = row[other], col[other]
            at.append(asks[row])
            places.append(first + col)
            products.append(scores[row, col])
        if not sum(map(len, at)):
            return None
        at, places, products = np.concatenate(at), np.concatenate(places), np.concatenate(products)
        # the k-th best product over all leaves, then the rows that could still be among the k best
        order = np.lexsort((-products, at))
        edges = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0)))
        sizes = np.diff(np.append(edges, len(order)))
        kth = np.full(len(q), -np.inf)
        enough = sizes >= k
        kth[at[order[edges[enough]]]] = products[order[edges[enough] + k - 1]]
        stay = products >= (kth - margin)[at]
        at, places = at[stay], places[stay]
        step = max(1, PAIR_VALUES // rows.shape[1])
        exact = np.concatenate([(q_rows[at[x : x + step]] * rows[places[x : x + step]]).sum(axis=1) for x in range(0, len(at), step)])
        return keep_best(at, ids[places], exact, k, q)

    def run(batches):
        held, rows_held = [], 0

        def merged():
            return keep_best(*[np.concatenate(x) for x in zip(*held)], k)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["query_id", "vec_id", "score"])

        columns = ("size", "q_ids", "q_whole", "visits", "leaves", "ids", "whole")
        for batch in batches:
            for at in range(batch.num_rows):
                size, q_ids, q_whole, bits, leaf, ids, whole = (batch.column(c)[at].as_py() for c in columns)
                q, ids, leaf = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(leaf, "<i4")
                q_rows, rows = np.frombuffer(q_whole, "<f8").reshape(len(q), size), np.frombuffer(whole, "<f8").reshape(len(ids), size)
                visited = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(q), -1), axis=1, count=leaves).astype(bool)
                found = near(q, q_rows, visited, ids, rows, leaf) if len(q) and len(ids) else None
                if found:
                    held.append(found)
                    rows_held += len(found[0])
                if rows_held > MERGE_ROWS:
                    held = [merged()]
                    rows_held = len(held[0][0])
                    if rows_held > MERGE_ROWS // 2:
                        yield out()
                        held, rows_held = [], 0
        if rows_held:
            held = [merged()]
            yield out()

    return run


def fit(vectors: DataFrame, k: int, sample: int, branch: int, leaf_rows: int, recall: float, trials: int):
    """(tree, visits, rows in all) from about ``sample`` rows, or up to ``SAMPLE_MOST`` as the table grows, and about ``SAMPLE_BYTES`` of vectors at most."""
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    sample = min(max(sample, min(SAMPLE_MOST, int(16 * n**0.5))), max(1000, SAMPLE_BYTES // (8 * (longest or 1))))
    share = min(1.0, sample / max(1, n))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(2 * sample)
    blocks = pack_blocks(picked, 1 << 20, None).collect()
    parts = [(np.frombuffer(b.ids, "<i8"), np.frombuffer(b.whole, "<f8").reshape(b.n, b.size)) for b in blocks]
    lengths = Counter()
    for ids, rows in parts:
        lengths[rows.shape[1]] += len(ids)
    size = max(lengths, key=lambda s: (lengths[s], s), default=0)
    parts = [(ids, rows) for ids, rows in parts if rows.shape[1] == size]
    ids = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, np.int64)
    rows = np.concatenate([x for _, x in parts]) if parts else np.empty((0, size))
    order = np.argsort(ids, kind="stable")
    rows = rows[order]
    rows = rows[(rows != 0).any(axis=1)]
    tree = Tree(rows, branch, leaf_rows)
    return tree, tree.calibrate(rows, k, recall, trials), n


def scored(vectors: DataFrame, queries: DataFrame, **options) -> tuple[int, int]:
    """(pairs of query and row that the search multiplies, all pairs), to stand beside its recall."""
    vectors, queries = valid(vectors), valid(queries).dropDuplicates(["vec_id", "embedding"])
    settings = {"k": K, "sample": SAMPLE, "branch": BRANCH, "leaf_rows": LEAF_SAMPLE, "recall": RECALL, "trials": TRIALS} | options
    tree, visits, n = fit(vectors, *[settings[x] for x in ("k", "sample", "branch", "leaf_rows", "recall", "trials")])
    leaves = max(1, tree.leaves)

    def per_leaf(counted):
        def run(batches):
            for batch in batches:
                sizes, lists = batch.column("size").to_pylist(), batch.column("leaves" if counted else "visits").to_pylist()
                queries_of = batch.column("q_ids").to_pylist() if not counted else None
                for i, (size, raw) in enumerate(zip(sizes, lists)):
                    if counted:
                        found = np.bincount(np.frombuffer(raw, "<i4"), minlength=leaves)
                    else:
                        found = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(queries_of[i]) // 8, -1), axis=1, count=leaves).sum(axis=0)
                    at = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size), pa.int32()), pa.array(at, pa.int32()), pa.array(found[at].astype(np.int64))], names=["size", "leaf", "n"])

        return run

    placed = pack_blocks(vectors, BLOCK, None).mapInArrow(_placed(tree, 1, settings["k"] + 1), "size int, slot int, leaves binary, ids binary, whole binary")
    asked = pack_blocks(queries, QUERY_BLOCK, None).mapInArrow(_asked(tree, visits, 1), "size int, slots array<int>, q_ids binary, q_whole binary, visits binary")
    rows, asks = [df.mapInArrow(per_leaf(c), "size int, leaf int, n long").groupBy("size", "leaf").agg(F.sum("n").alias(name)) for df, c, name in ((placed, True, "rows"), (asked, False, "asks"))]
    pairs = rows.join(asks, ["size", "leaf"]).agg(F.sum(F.col("rows") * F.col("asks"))).first()[0] or 0
    return pairs, n * queries.count()


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, branch: int = BRANCH, leaf_rows: int = LEAF_SAMPLE, recall: float = RECALL, trials: int = TRIALS, block: int = BLOCK
) -> DataFrame:
    """vectors, queries (vec_id, embedding, ...) -> query_id, rank, vec_id, score."""
    vectors, queries = valid(vectors), valid(queries).dropDuplicates(["vec_id", "embedding"])
    tree, visits, n = fit(vectors, k, sample, branch, leaf_rows, recall, trials)
    query_bytes = queries.agg(F.sum(8 * F.size("embedding") + 8 + tree.leaves // 8)).first()[0] or 0
    small = query_bytes <= BROADCAST_BYTES
    slots = 1 if small else max(queries.sparkSession.sparkContext.defaultParallelism, -(-n // block))
    schema = "size int, slot int, leaves binary, ids binary, whole binary"
    placed = pack_blocks(vectors, block, None).mapInArrow(_placed(tree, slots, k + 1), schema)
    schema = "size int, slots array<int>, q_ids binary, q_whole binary, visits binary"
    asked = pack_blocks(queries, QUERY_BLOCK, None).mapInArrow(_asked(tree, visits, slots), schema)
    if small:
        pairs = placed.drop("slot").join(F.broadcast(asked.drop("slots")), "size")
    else:
        pairs = asked.withColumn("slot", F.explode("slots")).drop("slots").join(placed, ["size", "slot"])
    return best(pairs.mapInArrow(_scored(k, tree.leaves), "query_id long, vec_id long, score double"), k)
