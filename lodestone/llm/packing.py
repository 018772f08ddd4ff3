"""Operator 10: packing documents into fixed-length token sequences.

Documents fall into randomised groups by a hash; each group is packed on its own by
first-fit decreasing: whole ``capacity``-token chunks are sequences at once, the
remainders are placed, longest first, in the first open sequence with room, found by
walking a tournament tree whose inner nodes hold the largest room below them.

What first-fit leaves open is then closed by cutting: the emptiest sequences of the
group are taken apart and their pieces fill the gaps of the fullest (gaps under
``min_piece`` stay). So a group ends with at most one sequence that is far from full.

Plan: one shuffle of the documents, by partitions that each hold many groups: as many as
three times the cores or ``PARTITION_BYTES`` need, and at most ``PARTITIONS``. Tasks stream
their groups, sorted, and hold one group at a time (about ``group_bytes`` of text, and any one
text whole). Group and order depend on the rows' content only, so a task that is run again gives
the same sequences. Equal rows (same id and text) would all fall in one group: those that come more
than ``COPIES`` times are found by a count of hashes and dealt by their place in the input too,
which a table read from files gives alike each time.

Tokenising: ids are those of ``tokenizers`` without added special tokens; the strings of the vocabulary's
added tokens in a text become their ids, as that library does by default. Byte-level BPE never
merges across the pre-tokeniser's pieces, and a single space between words always starts a
piece. So texts are cut at such spaces, and what a worker has met before comes from a bounded cache.

Edge cases: null text is empty (one end-of-document id); repeated rows are packed each;
a document longer than the capacity is cut, however long; an empty table gives no pieces; null
doc_ids are kept; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY, MIN_PIECE, GROUP_BYTES, END_ID = 1024, 16, 4 << 20, 0
#: Bytes of text for a shuffle partition (sorted, on disk if need be, and streamed), most partitions, and rows that may be equal in a group.
PARTITION_BYTES, PARTITIONS, COPIES = 256 << 20, 65_536, 1000
#: Keys of such rows (8 bytes each) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Entries of a worker's cache; it is emptied when full.
CACHE = 200_000
#: Fixed value: the public byte-level BPE pre-tokeniser's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space beside other white space, or at an end of the text.
BLANKS = re.compile(r"\s | \s|^ | $").search

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def byte_of_sign() -> dict[str, int]:
    """The byte-level vocabulary's signs: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens(dict):
    """Text -> little-endian 32-bit ids, as bytes; the dict caches what follows a single space."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        special = {x["content"] for x in vocabulary["added_tokens"]}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)").search
        signs = byte_of_sign()
        ranks = {bytes(signs[c] for c in x): i for x, i in vocabulary["model"]["vocab"].items() if x not in special}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def with_added(self, text: str) -> bytes:
        """The ids of a text that names added tokens, by the library itself."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[part] = found = array("I", self.encode(" " + part)).tobytes()
        return found

    def ids(self, text: str) -> bytes:
        """A single space between two other signs always starts a piece of the pattern, so texts are cut there."""
        if self.added(text):
            return self.with_added(text)
        parts = text.split(" ")
        if len(parts) < 3 or BLANKS(text):
            return self.whole(text)
        return self.whole(parts[0]) + b"".join(map(self.__getitem__, islice(parts, 1, None)))


class RoomTree:
    """Tournament tree over bins: the first bin with at least so much room."""

    def __init__(self, bins: int, capacity: int):
        self.n = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.n)

    def place(self, size: int) -> int:
        room, i = self.room, 1
        while i < self.n:
            i *= 2
            if room[i] < size:
                i += 1
        at = i - self.n
        room[i] -= size
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes`` (each 1 to capacity)."""
    tree, bins = RoomTree(max(1, len(sizes)), capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = tree.place(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def close_gaps(bins: list[list[tuple]], capacity: int, min_piece: int) -> list[list[tuple]]:
    """Take the emptiest bins apart to fill the others' gaps. Pieces: (doc, start, length)."""
    order = sorted(([sum(p[2] for p in b), i] for i, b in enumerate(bins)), reverse=True)
    lo, hi = 0, len(order) - 1
    while lo < hi:
        gap = capacity - order[lo][0]
        if gap < min_piece:
            lo += 1
            continue
        target, source = bins[order[lo][1]], bins[order[hi][1]]
        doc, start, length = source.pop()
        take = min(gap, length)
        if length - take:
            source.append((doc, start, length - take))
        target.append((doc, start + length - take, take))
        order[lo][0] += take
        order[hi][0] -= take
        if not source:
            hi -= 1
    return [b for b in bins if b]


def pack_group(docs: list[tuple], group: int, capacity: int, min_piece: int) -> Iterator[tuple]:
    """docs: (doc_id, ids as bytes) -> rows of SCHEMA."""
    full, rest = [], []
    for d, (_, ids) in enumerate(docs):
        n = len(ids) // 4
        whole = n - n % capacity
        full += [[(d, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((d, whole, n - whole))
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    for seq, pieces in enumerate(full + close_gaps(bins, capacity, min_piece)):
        at = 0
        for d, start, length in pieces:
            doc_id, ids = docs[d]
            yield doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, (group << 32) | seq, at
            at += length


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, min_piece: int = MIN_PIECE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> pieces (SCHEMA). ``vocabulary``: path of a tokenizer file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("order", F.xxhash64("doc_id", "text"))
    copies = rows.groupBy("order").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 1).alias("bytes"))
    folded = cut(copies.groupBy(F.when(F.col("n") > COPIES, F.col("order")).alias("order")).agg(F.sum("bytes").alias("bytes")))
    many, total = folded.where(F.col("order").isNotNull()).select("order"), folded.agg(F.sum("bytes")).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    if not many.isEmpty():
        keys = many.withColumn("many", F.lit(True))
        rows = rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "order", "left")
        rows = rows.withColumn("order", F.when(F.col("many"), F.xxhash64("order", "place")).otherwise(F.col("order")))
    parts = int(min(groups, PARTITIONS, max(3 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES))))
    rows = rows.withColumn("group", F.pmod("order", F.lit(groups)))
    rows = rows.repartitionById(parts, F.pmod("group", F.lit(parts)).cast("int")).sortWithinPartitions("group", "order", "doc_id")

    def packed(batches):
        tokens, held, now = Tokens(vocabulary), [], None
        columns = [c.split()[0] for c in SCHEMA.split(", ")]

        def pieces():
            made = zip(*pack_group(held, now, capacity, min_piece))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=columns)

        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text, group in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "group")]):
                if group != now and held:
                    yield pieces()
                    held = []
                now = group
                held.append((doc_id, tokens.ids(text) + end))
        if held:
            yield pieces()

    return rows.select("doc_id", "text", "group").mapInArrow(packed, SCHEMA)
