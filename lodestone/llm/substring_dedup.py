"""Operator 9: exact substring dedup by relative Lempel-Ziv factors against indexed reference blocks.

A word is removed if some window of ``WINDOW`` words that covers it also starts at
another place of the corpus. Every document is factored against the rest of the corpus; a factor of
``WINDOW`` words or more is a duplicate span.

Reference blocks and their index. Every window picks the least hash among its ``SEED_WORDS``-word
grams (its anchor). Equal windows pick equal anchors at equal offsets, and neighbouring windows
share theirs, so a text has about one anchor in fifteen words. An anchor's *block* is
the span of all windows that picked it. The blocks of all documents are the reference, and their index is the
anchor: a factor of a window or more can only be found in blocks of its own anchor, so no task needs
the index of the whole reference, and no document meets a block that it shares nothing with.

Factoring, by what the index tells of an anchor:

* one block only: no long factor passes through it, its windows are unique;
* equal blocks only: each block is one factor of the other's;
* 2 to ``FACTORED`` different blocks: each is parsed greedily against the others. All are laid over each other at
  the anchor; the longest factor from a place is the one that reaches furthest before the words differ, and the parse goes
  on behind the last window it holds. Both factor boundaries are checked on the words themselves, so a
  factor ends exactly where the words differ;
* more: the parse of m blocks against each other would grow with m squared, so their windows are counted one by one,
  as factors of just a window, combined before the shuffle.

Only what is unique is reported back to a document, as a grouped count of one carries its
place along (the least place of a group is *the* place if the count is one). So no group
without bound is ever collected or joined to its members: a passage or copy that a third of all
documents hold is combined before the shuffle.

In hashes a word stands with 128 bits (XXH3 of its bytes, no polynomial): windows have two hashes, each over another half
of the words' bits, a block its anchor and a hash over both, a text two hashes. A text is
identified by its content; equal texts share one result, as each of their windows
repeats.

Edge cases: null text has no words; shorter texts than a window keep all; words of any length and very long texts are
read whole; repeated rows remove each other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import cut, key128

WINDOW, SEED_WORDS, FACTORED = 35, 8, 32
#: Anchors (8 bytes each) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

#: Odd multipliers of the polynomial hashes of words in a window, and of a block's offset.
_WORD, _OTHER, _OFFSET = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int):
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            step = np.ones(n, dtype=np.uint64)
            step[1:] = self.base
            self.up = np.multiply.accumulate(step)
            step[1:] = self.inverse
            self.down = np.multiply.accumulate(step)
        return self.up, self.down


_powers = {int(b): _Powers(b) for b in (_WORD, _OTHER)}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, whatever its place."""
    up, down = _powers[int(base)](len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(raw: bytes) -> np.ndarray:
    """Both halves of the 128-bit hash of each word of a text, as two rows."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, raw.split())), dtype="<u8").reshape(-1, 2).T.copy()


def anchors(words: np.ndarray, window: int, seed: int):
    """(at, first, last, hash) of each anchor: its word, its first and last window, its hash."""
    n = len(words)
    if n < window:
        return None
    starts = np.arange(n - seed + 1)
    grams = _mix(_spans(words, starts, starts + seed, _WORD))
    # Least of each window by doubling; the place stands in the low half, so that of ties the first is picked.
    least, size, span = grams & np.uint64(0xFFFFFFFF << 32) | starts.astype(np.uint64), 1, window - seed + 1
    while 2 * size <= span:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    picked = (np.minimum(least[: n - window + 1], least[span - size :]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(picked[1:] != picked[:-1]) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [len(picked)])) - 1
    at = picked[first]
    return at, first, last, grams[at]


def blocks_of(words: np.ndarray, window: int, seed: int):
    found = anchors(words[0], window, seed)
    if found is None:
        return None
    at, first, last, hashes = found
    offset = (at - first).astype(np.uint64)
    # one number for a block's content: halves of the words' bits go in by different multipliers
    own = _mix(_mix(_spans(words[1], first, last + window, _OTHER) + offset * _OFFSET) + _spans(words[0], first, last + window, _WORD))
    return hashes, own, first, last, at


def windows_of(words: np.ndarray, window: int, wanted: list[tuple[int, int]]):
    """Places and two hashes of the windows first..last of each wanted block."""
    at = np.concatenate([np.arange(a, b + 1) for a, b in wanted]) if wanted else np.empty(0, np.int64)
    return at, _mix(_spans(words[0], at, at + window, _WORD)), _mix(_spans(words[1], at, at + window, _OTHER))


def factor(blocks: list[tuple[int, np.ndarray]], window: int) -> list[np.ndarray]:
    """Greedy parse of each block (place of its anchor, numbers of its words) against all the others.

    Gives for each block the windows (counted from its first word) inside no factor of ``window`` words or more.
    """
    left = max(at for at, _ in blocks)
    width = left + max(len(words) - at for at, words in blocks)
    laid = np.full((len(blocks), width), -1)
    for k, (at, words) in enumerate(blocks):
        laid[k, left - at : left - at + len(words)] = words
    out = []
    for k, (at, words) in enumerate(blocks):
        same = (laid == laid[k]) & (laid[k] >= 0)
        same[k] = False
        # reach[y, x]: the first place from x on where block y's words differ, so x to reach is a factor
        reach = np.where(same, width, np.arange(width)[None, :])
        reach = np.minimum.accumulate(reach[:, ::-1], axis=1)[:, ::-1].max(axis=0)
        lone, x, end = [], left - at, left - at + len(words)
        while x + window <= end:
            if reach[x] - x >= window:
                x = int(reach[x]) - window + 1  # behind the last window that the factor holds
            else:
                lone.append(x - left + at)
                x += 1
        out.append(np.array(lone, dtype=np.int32))
    return out


def _as_lists(parts: list, kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind) if kind != np.int64 else flat.astype(np.uint64).view(np.int64)))


def _raw(column):
    return (b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist())


def _blocks(window: int, seed: int):
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)

    def run(batches):
        for batch in batches:
            found = [blocks_of(word_hashes(x), window, seed) or none for x in _raw(batch.column("text"))]
            lists = [_as_lists([f[k] for f in found], np.int64 if k < 2 else np.int32) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *lists], names=["a", "b", "anchor", "content", "first", "last", "at"])

    return run


def _segments(window: int):
    """The words of each wanted block."""
    names = ["anchor", "a", "b", "first", "n", "at", "words"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]

    def run(batches):
        for batch in batches:
            out = []
            for a, b, raw, check in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), _raw(batch.column("text")), batch.column("check").to_pylist()):
                words = raw.split()
                out += [(c["anchor"], a, b, c["first"], c["n"], c["at"] - c["first"], b" ".join(words[c["first"] : c["last"] + window])) for c in check]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    return run


def _windows(window: int):
    """Places and hashes of the windows of each wanted block."""

    def run(batches):
        for batch in batches:
            checks = batch.column("check").to_pylist()
            found = [windows_of(word_hashes(x), window, [(c["first"], c["last"]) for c in check]) for x, check in zip(_raw(batch.column("text")), checks)]
            counts = [np.repeat([c["n"] for c in check], [c["last"] - c["first"] + 1 for c in check]) for check in checks]
            lists = [_as_lists([f[0] for f in found], np.int32), _as_lists([f[1] for f in found], np.int64), _as_lists([f[2] for f in found], np.int64), _as_lists(counts, np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *lists], names=["a", "b", "place", "h", "g", "n"])

    return run


def _factored(window: int):
    def run(batches):
        for batch in batches:
            out = []
            for group in batch.column("blocks").to_pylist():
                known: dict[bytes, int] = {}
                split = [x["words"].split(b" ") for x in group]
                parsed = factor([(x["at"], np.array([known.setdefault(w, len(known)) for w in words])) for x, words in zip(group, split)], window)
                out += [(x["a"], x["b"], lone + np.int32(x["first"])) for x, lone in zip(group, parsed) if x["n"] == 1 and len(lone)]
            a, b, lone = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(lone, pa.list_(pa.int32()))], names=["a", "b", "lone"])

    return run


def keep_words(raw: bytes, window: int, unique: list[tuple[int, int]] | None, lone: list[int]):
    """Words, and which stay. unique: spans of windows of blocks that stand nowhere else
    and needed no comparison; lone: single windows found to be unique."""
    words = raw.split()
    n = len(words)
    kept = np.ones(n, dtype=bool)
    if n >= window:
        repeated = np.ones(n - window + 1, dtype=np.int64)
        for a, b in unique or ():
            repeated[a : b + 1] = 0
        repeated[np.asarray(lone, dtype=np.int64)] = 0
        steps = np.zeros(n + 1, dtype=np.int64)
        steps[: n - window + 1] += repeated
        steps[window : n + 1] -= repeated
        kept = np.cumsum(steps[:n]) == 0
    return words, kept


def _kept(window: int):
    def run(batches):
        for batch in batches:
            out = []
            for raw, unique, lone in zip(_raw(batch.column("text")), batch.column("unique").to_pylist(), batch.column("lone").to_pylist()):
                words, kept = keep_words(raw, window, [(u["first"], u["last"]) for u in unique or ()], lone or [])
                text = b" ".join(words if kept.all() else [words[i] for i in np.flatnonzero(kept)])
                out.append((len(words), int(len(words) - kept.sum()), hashlib.sha256(text).hexdigest()))
            n, removed, digest = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _exploded(df: DataFrame, *lists: str) -> DataFrame:
    return df.select("a", "b", F.explode(F.arrays_zip(*lists)).alias("x")).select("a", "b", "x.*")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, factored: int = FACTORED) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256."""
    a, b = key128(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", a.alias("a"), b.alias("b"))
    shape = "a long, b long, anchor array<long>, content array<long>, first array<int>, last array<int>, at array<int>"
    blocks = _exploded(rows.select("a", "b", "text").mapInArrow(_blocks(window, seed), shape), "anchor", "content", "first", "last", "at")
    # Of a group of one, each maximum is the value itself: the place of a unique anchor.
    # An anchor with several contents goes along in ``open``, under whatever key.
    of_anchor = blocks.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("least"), F.max("content").alias("most"), *[F.max(c).alias(c) for c in ("a", "b", "first", "last")]
    )
    told = cut(
        of_anchor.where("n = 1 OR least <> most")
        .groupBy("a", "b")
        .agg(F.collect_list(F.when(F.col("n") == 1, F.struct("first", "last"))).alias("unique"), F.collect_list(F.when(F.col("n") > 1, F.col("anchor"))).alias("open"))
    )
    open_anchors = told.select(F.explode("open").alias("anchor"))
    if open_anchors.count() <= BROADCAST_ROWS:
        open_anchors = F.broadcast(open_anchors)
    # One text for each content of such an anchor.
    contents = cut(blocks.join(open_anchors, "anchor").groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "first", "last", "at")).alias("place")))
    crowded = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > factored).select("anchor")
    crowded = cut(crowded)

    def texts_with(places, *fields):
        """The texts of the wanted places, each with its list ``check``."""
        check = F.struct(*fields, "place.first", "place.last", F.least("n", F.lit(2)).cast("int").alias("n"))
        checks = places.select("place.a", "place.b", check.alias("check")).groupBy("a", "b").agg(F.collect_list("check").alias("check"))
        # doc_id is not needed here, but with it the texts' exchange is the same as below and is reused
        return rows.join(cut(checks), ["a", "b"]).select("a", "b", "doc_id", "text", "check")

    few = contents.join(crowded, "anchor", "left_anti")
    segments = texts_with(few, "anchor", "place.at").mapInArrow(_segments(window), "anchor long, a long, b long, first int, n int, at int, words binary")
    # a text with copies is read for each of them, but a set holds its block once: at most ``FACTORED``
    groups = segments.groupBy("anchor").agg(F.collect_set(F.struct("a", "b", "first", "n", "at", "words")).alias("blocks"))
    lone = groups.select("blocks").mapInArrow(_factored(window), "a long, b long, lone array<int>")
    if not crowded.isEmpty():
        texts = texts_with(contents.join(crowded, "anchor", "left_semi"))
        shape = "a long, b long, place array<int>, h array<long>, g array<long>, n array<int>"
        windows = _exploded(texts.mapInArrow(_windows(window), shape), "place", "h", "g", "n")
        counted = windows.groupBy("h", "g").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("a", "b", "place")]).where("n = 1")
        lone = lone.unionByName(counted.select("a", "b", F.array("place").alias("lone")))
    lone = lone.groupBy("a", "b").agg(F.flatten(F.collect_list("lone")).alias("lone"))
    unique = told.where(F.size("unique") > 0).select("a", "b", "unique")
    whole = rows.join(unique, ["a", "b"], "left").join(lone, ["a", "b"], "left")
    return whole.select("doc_id", "text", "unique", "lone").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
