"""Operator 13: ranked lexical search over inverted treaps.

A document's impact for a term is a saturating function of its occurrences and the document's length; its score sums the
weighted impacts of the item's terms. Documents are dealt in blocks. In a block each term has a treap of its postings:
doc_id is the search order, impact the heap order (equal impacts by a mixed place, so that no treap degenerates), so a subtree's
root bounds all of it.

A search walks all treaps of its terms at once over ranges of documents. In a range, each term stands at the root of
its subtree there; the sum of these maxima bounds every score of the range, which is pruned if it cannot enter
the top k. Otherwise the range is split at the document of the largest maximum: that document is scored exactly, and
each term steps down to its subtree in both halves. Ranges of largest bounds go first, ``BEAM`` of them, then twice as many each time. The k-th score so far, first
of a share of the blocks (``FLOOR_SHARE``), then of the task's own blocks, is the floor; it only spares work.

Plan: one pass over the texts makes the blocks (no shuffle: a block is a run of rows of an input partition, of at most ``BLOCK`` documents
and about ``POSTINGS`` postings), which are written: only postings of the terms that items have, eight bytes each. One aggregation gives
the statistics (documents, terms, documents of each term). Items go to the tasks, at most about ``ITEMS`` at a time; more are searched
in further passes over the blocks. A task returns at most k documents an item; a window ranks these.

Edge cases: null and empty texts have no terms: such a document counts nowhere and is never found, such an item finds nothing;
null doc_ids are found, last among equals (as is the largest long, which comes back as null); null item_ids are items; repeated documents are found each; equal items (same id and text) are asked once, different texts of one id
each; an empty table gives an empty result; very long texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import byte_words
from .common import cut

K, LENGTH_SHARE = 10, 90
BLOCK, POSTINGS, ITEMS, BEAM, FLOOR_SHARE = 32_768, 1_000_000, 2_000, 32, 1 / 32
#: Stands for a null doc_id: after all others.
NULL = np.iinfo(np.int64).max

INDEX = "documents long, terms_in_all long, doc_ids array<long>, lengths array<int>, terms array<string>, holding array<int>, places array<int>, times array<int>"


def terms_of(text: str | None) -> list[str]:
    return [w.decode("utf-8", "replace") for w in byte_words(text.encode("utf-8", "surrogatepass") if text else None)]


class _Block:
    """Collects documents until they make a block."""

    def __init__(self, wanted: set[bytes] | None):
        self.wanted = wanted.__contains__ if wanted is not None else None
        self.clear()

    def clear(self):
        self.documents = self.terms_in_all = 0
        self.number: dict[bytes, int] = {}
        self.ids, self.lengths, self.sizes, self.terms, self.times = (array(kind) for kind in "qiiii")

    def add(self, doc_id: int | None, text: bytes | None):
        words = byte_words(text)
        if not words:
            return
        self.documents += 1
        self.terms_in_all += len(words)
        found = Counter(words if self.wanted is None else filter(self.wanted, words))
        if found:
            self.ids.append(NULL if doc_id is None else doc_id)
            self.lengths.append(len(words))
            self.sizes.append(len(found))
            number = self.number
            self.terms.extend([number.setdefault(w, len(number)) for w in found])
            self.times.extend(found.values())

    def row(self) -> pa.RecordBatch:
        """One row of INDEX; postings by term, then doc_id."""
        ids, lengths, sizes, terms, times = (np.array(x) for x in (self.ids, self.lengths, self.sizes, self.terms, self.times))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        places = np.repeat(place, sizes)
        by_term = np.lexsort((places, terms))
        names = [w.decode("utf-8", "replace") for w in self.number]
        columns = [ids[order], lengths[order], np.bincount(terms, minlength=len(names)).astype(np.int32), places[by_term], times[by_term]]
        ids, lengths, *rest = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in columns]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.documents], pa.int64()), pa.array([self.terms_in_all], pa.int64()), ids, lengths, pa.array([names], pa.list_(pa.string())), *rest],
            names=[c.split()[0] for c in INDEX.split(", ")],
        )


def build_index(docs: DataFrame, wanted: list[str] | None = None, block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """docs (doc_id, text, ...) -> INDEX, a row a block. ``wanted`` leaves out the postings of other terms (statistics still count them)."""
    names = {w.encode() for w in wanted} if wanted is not None else None

    def run(batches):
        held = _Block(names)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.add(doc_id, text)
                if len(held.ids) >= block or len(held.terms) >= postings:
                    yield held.row()
                    held.clear()
        if held.documents:
            yield held.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX)


class Statistics:
    """Documents with terms, all their terms, and the documents of each wanted term."""

    def __init__(self, index: DataFrame, wanted: list[str]):
        self.blocks, n, total = index.agg(F.count(F.lit(1)), F.sum("documents"), F.sum("terms_in_all")).first()
        self.documents, self.terms = n or 0, total or 0
        each = index.select(F.explode(F.arrays_zip("terms", "holding")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.holding").alias("n"))
        names = index.sparkSession.createDataFrame([(w,) for w in wanted], "term string")
        self.holding = {r["term"]: r["n"] for r in each.join(F.broadcast(names), "term").groupBy("term").agg(F.sum("n").alias("n")).collect()}

    def weight(self, term: str) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.holding.get(term, 0) + 1)))

    def impacts(self, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of postings, from occurrences and the documents' lengths; below 1,000,000."""
        length = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * self.documents // self.terms for n in lengths.tolist()], dtype=np.int64)
        return (1_000_000_000 * times) // (1000 * times + 8 * length)


def treaps(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of the runs that begin at ``starts``, and left and right children (-1: none): places in order, the largest key on top."""
    n = len(keys)
    left, right, roots, key = [-1] * n, [-1] * n, [-1] * (len(starts) - 1), keys.tolist()
    for r, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        spine = []  # from the root down the right edge
        for i in range(a, b):
            below = -1
            while spine and key[spine[-1]] < key[i]:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        if spine:
            roots[r] = spine[0]
    return np.array(roots, dtype=np.int64), np.array([*left, -1], dtype=np.int64), np.array([*right, -1], dtype=np.int64)


def mixed(places: np.ndarray) -> np.ndarray:
    """Numbers of 40 bits that look random, alike for equal places."""
    z = (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(24)).astype(np.int64)


class InvertedTreaps:
    """The treaps of a block: at each posting a place (of a document), an impact and two children."""

    def __init__(self, row: dict, statistics: Statistics):
        self.doc_ids, lengths = row["doc_ids"], row["lengths"]
        self.places = row["places"].astype(np.int64)
        holding = row["holding"].astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(holding)))
        self.number = {w: i for i, w in enumerate(row["terms"])}
        self.impact = np.append(statistics.impacts(row["times"].astype(np.int64), lengths[self.places]), 0)  # the last: of no posting
        self.root, self.left, self.right = treaps(self.impact[:-1] << 40 | mixed(self.places), starts)
        self.places = np.append(self.places, 0)
        terms = np.repeat(np.arange(len(holding)), holding)
        self.sorted = terms * len(self.doc_ids) + self.places[:-1]  # ascending

    def _impact_at(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The impact of each of the terms (columns) on each of the places (rows)."""
        want = terms[None, :] * len(self.doc_ids) + places[:, None]
        at = np.minimum(np.searchsorted(self.sorted, want), len(self.sorted) - 1)
        return np.where(self.sorted[at] == want, self.impact[at], 0)

    def _within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where terms that stand above the ranges [low, high) stand in them: their largest there, or -1."""
        nodes, low, high = nodes.copy(), low[:, None], high[:, None]
        while True:
            at = self.places[nodes]
            beyond, before = (nodes >= 0) & (at >= high), (nodes >= 0) & (at < low)
            if not (beyond.any() or before.any()):
                return nodes
            nodes[beyond] = self.left[nodes[beyond]]
            nodes[before] = self.right[nodes[before]]

    def search(self, terms: dict[str, int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores (above 0) of the k best, by score, then doc_id, of those that reach ``floor``; and how many documents were scored."""
        here = [(self.number[w], weight) for w, weight in terms.items() if w in self.number and weight > 0]
        best = np.zeros((0, 2), dtype=np.int64)  # -score, place
        if not here:
            return best[:, 1], best[:, 0], 0
        number, weight = (np.array(x, dtype=np.int64) for x in zip(*here))
        nodes, low, high = self.root[number][None, :], np.array([0]), np.array([len(self.doc_ids)])
        bounds, visited, floor, beam = (self.impact[nodes] * weight).sum(axis=1), 0, max(floor, 1), BEAM
        while len(nodes):
            order = np.argsort(-bounds, kind="stable")
            order = order[: np.searchsorted(-bounds[order], -floor, side="right")]  # an equal score may have a smaller doc_id
            now, later, beam = order[:beam], order[beam:], 2 * beam
            if not len(now):
                break
            ranges, l, h = nodes[now], low[now], high[now]
            split = self.places[ranges[np.arange(len(now)), np.argmax(np.where(ranges >= 0, self.impact[ranges] * weight, -1), axis=1)]]
            scores = (self._impact_at(number, split) * weight).sum(axis=1)
            visited += len(now)
            good = scores >= floor
            best = np.concatenate([best, np.stack([-scores[good], split[good]], axis=1)])
            best = best[np.lexsort((best[:, 1], best[:, 0]))][:k]
            if len(best) == k:
                floor = max(floor, -int(best[-1, 0]))
            l, h = np.concatenate([l, split + 1]), np.concatenate([split, h])
            halves = self._within(np.concatenate([ranges, ranges]), l, h)
            top = (self.impact[halves] * weight).sum(axis=1)
            may = top >= floor
            nodes, low, high = np.concatenate([nodes[later], halves[may]]), np.concatenate([low[later], l[may]]), np.concatenate([high[later], h[may]])
            bounds = np.concatenate([bounds[later], top[may]])
        return best[:, 1], -best[:, 0], visited


def search_blocks(index: DataFrame, items: list[dict[str, int]], statistics: Statistics, k: int, floors: list[int]) -> DataFrame:
    """INDEX -> (item, doc_id, score, visited): at most k rows an item and task. items: weights of terms."""

    def run(batches):
        found = [np.zeros((0, 2), dtype=np.int64) for _ in items]  # -score, doc_id
        floor, visited = list(floors), [0] * len(items)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("doc_ids", "lengths", "terms", "holding", "places", "times")}
                row = {c: v.to_pylist() if c == "terms" else v.to_numpy(zero_copy_only=False) for c, v in row.items()}
                if not len(row["places"]):
                    continue
                block = InvertedTreaps(row, statistics)
                for q, terms in enumerate(items):
                    places, scores, n = block.search(terms, k, floor[q])
                    visited[q] += n
                    if len(places):
                        all_of = np.concatenate([found[q], np.stack([-scores, block.doc_ids[places]], axis=1)])
                        found[q] = all_of[np.lexsort((all_of[:, 1], all_of[:, 0]))][:k]
                        if len(found[q]) == k:
                            floor[q] = max(floor[q], -int(found[q][-1, 0]))
        for q, rows in enumerate(found):
            if visited[q]:
                ids = pa.array(rows[:, 1], mask=rows[:, 1] == NULL)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * (len(rows) + 1), pa.int32()), pa.concat_arrays([ids, pa.array([None], pa.int64())]), pa.array([*(-rows[:, 0]).tolist(), None], pa.int64()), pa.array([0] * len(rows) + [visited[q]], pa.int64())],
                    names=["item", "doc_id", "score", "visited"],
                )

    return index.mapInArrow(run, "item int, doc_id long, score long, visited long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score): the k best of each item."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = items.select("item_id", "text").distinct()
    portions = max(1, -(-asked.count() // ITEMS))
    out = None
    for p in range(portions):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == p).collect()  # about ITEMS rows
        each = [sorted(set(terms_of(r["text"]))) for r in rows]
        wanted = sorted({w for terms in each for w in terms})
        index = cut(build_index(docs, wanted))
        statistics = Statistics(index, wanted)
        weighted = [{w: statistics.weight(w) for w in terms} for terms in each]
        some = index.where(F.pmod(F.xxhash64("documents", "terms_in_all", F.get("doc_ids", 0)), F.lit(1000)) < F.lit(1000 * FLOOR_SHARE))
        floors = [0] * len(rows)
        if statistics.blocks * FLOOR_SHARE >= 1:
            for r in ranked(search_blocks(some, weighted, statistics, k, floors), k).where(F.col("rank") == k).collect():
                floors[r["item"]] = r["score"]
        best = ranked(search_blocks(index, weighted, statistics, k, floors), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
