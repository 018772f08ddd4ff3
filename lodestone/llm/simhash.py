"""Operator 7: SimHash near-duplicates by covering locality-sensitive hashing.

A document's 64-bit fingerprint is the bitwise majority of its shingles' XXH64 hashes.
Fingerprints within ``RADIUS`` differing bits are linked; classes are the components.

Covering masks: bit i gets a vector m(i) of radius+1 bits, and table t (a non-zero
vector of radius+1 bits) keeps the bits with odd parity of m(i) & t. Any radius bits
span at most radius dimensions, so some t is orthogonal to all of them: every pair within
the radius agrees on all kept bits of that table. 15 tables keep 34 or fewer of 64 bits each
and miss no pair.

Equal fingerprints collapse first, so copies cost one row. A bucket (table, kept bits)
of more than ``BUCKET`` distinct fingerprints is never compared whole: it is split again
by the pigeonhole principle. Its free bits fall in radius+1 blocks and any pair
within the radius agrees on one of them, so the members go to radius+1 sub-buckets
keyed by that block. This repeats until few free bits are left; a bucket with f free
bits holds at most 2^f fingerprints. In a bucket, members are linked by a search that
emits a spanning forest and not the pairs.

``prints`` > 1 gives a text further fingerprints, of the same shingles' hashes mixed anew. Their differing bits are
independent, so more of the near copies lie within the radius in one of them; texts are linked if they do in any. The
spaces of the fingerprints are searched apart, each by the same tables, and their links carried back to the first one.

``confirmed_duplicates`` takes such links as first candidates: it compares the shingles of the linked texts exactly, and finds all other links
of that similarity by prefix filtering: a set that holds most of another one holds one of its rarest members.

Edge cases: null or blank text has fingerprint zero, linked like any other; fewer than three
words: one shingle of them all; repeated rows each come back; a null doc_id takes its
class's least id, which is null if no row has one (``root`` tells such classes apart); an empty table gives an empty result; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_few, few, key128, shuffles_freed
from .components import components

RADIUS, SHINGLE, SEED, BUCKET = 3, 3, 42, 2048
#: Confirmation: least similarity of sets of shingles of so many words; up to so many fingerprints or texts, all pairs are candidates.
SIMILARITY, WORDS, WHOLE = 0.8, 5, 6
#: Search of all links: the part (one in so many) of a text's shingles by which the prefix is longer; rounds with one head a shingle while there are over ``FEW`` pairs a row.
SPARE, HEAD_ROUNDS, FEW = 20, 6, 16
#: Texts whose shingles a Python worker holds at a time.
TEXTS = 512
#: Row keys (16 bytes each) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    vectors = (1 << (radius + 1)) - 1
    m = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (m[i] & t).bit_count() & 1) for t in range(1, vectors + 1)]


BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """64-bit number whose bits are set in over half of the uint64 hashes."""
    if not len(hashes):
        return 0
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        ones = BITS_OF_BYTE[columns].sum(axis=0).reshape(64)
    else:
        ones = np.concatenate([np.bincount(columns[:, j], minlength=256) @ BITS_OF_BYTE for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text; of the whole sequence if it is shorter than one."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    joined = b" ".join(words)
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)


def fingerprint_set(text: str | None, shingle: int = SHINGLE, seed: int = SEED, prints: int = 1) -> list[int]:
    """The fingerprint of a text and its further ones; all are zero without words."""
    hashes = shingle_hashes(text, shingle, seed)
    return [majority(hashes if k == 0 else mixed(hashes, k)) for k in range(prints)]


MASK = (1 << 64) - 1


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """uint64 hashes mixed anew for the k-th further fingerprint (the finaliser of SplitMix64)."""
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & MASK)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _slices(batches):
    """The same rows in small batches, so that few texts' shingles are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, prints: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (the fingerprint as a signed long), more (the further ones), a and b (which tell rows apart), t1 and t2 (texts)."""

    def run(batches):
        for batch in _slices(batches):
            sets = [fingerprint_set(t, shingle, seed, prints) for t in batch.column("text").to_pylist()]
            flat = np.array(sets, dtype=np.uint64).reshape(len(sets), prints).view(np.int64)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (prints - 1)), pa.array(flat[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.ascontiguousarray(flat[:, 0])), more, *[batch.column(c) for c in keys]], names=["doc_id", "fp", "more", *keys])

    keys = ["a", "b", "t1", "t2"]
    of = dict(zip(keys, [*key128(F.col("doc_id"), F.col("text")), *key128(F.col("text"))]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(k) for k, c in of.items()]).mapInArrow(run, "doc_id long, fp long, more array<long>, a long, b long, t1 long, t2 long")


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of the values (distinct, int64) within the radius."""
    links, rest = [], values.view(np.uint64)  # bitwise_count is of the absolute value
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                links.append(np.stack([np.full(len(found), at), found], axis=1))
                frontier += list(found)
                rest = rest[~near]
    return np.concatenate(links).view(np.int64) if links else np.empty((0, 2), np.int64)


def pairs_within(values: np.ndarray, radius: int) -> np.ndarray:
    """All pairs of the values (distinct, int64) within the radius."""
    plain = values.view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(plain[:, None] ^ plain[None, :]) <= radius, 1))
    return np.stack([values[i], values[j]], axis=1)


def _linked(radius: int, whole: int = 0):
    def run(batches):
        for batch in batches:
            lists = batch.column("fps")
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            at = offsets[:-1][sizes == 2]
            a, b = flat[at], flat[at + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            links = [np.stack([a[near], b[near]], axis=1)]
            for k in np.flatnonzero(sizes > 2):
                members = flat[offsets[k] : offsets[k + 1]]
                links.append(pairs_within(members, radius) if len(members) <= whole else forest(members, radius))
            links = np.concatenate(links)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    return run


def _blocks(free: int, n: int) -> list[int]:
    """Masks that deal the free bits to n blocks."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in bits[k::n]) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(members: DataFrame, masks: list[int], space: list[str]) -> DataFrame:
    """members (space, fp) -> (space, table, kept, fp), a row for each mask."""
    tables = F.array(*[F.struct(F.lit(_signed(m)).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for m in masks])
    return members.select(*space, "fp", F.explode(tables).alias("t")).select(*space, "t.table", "t.kept", "fp")


def link(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, whole: int = 0) -> DataFrame:
    """fps (fp, distinct) -> (u, v): links within the radius that join all that belong together; all of them in buckets of up to ``whole``.

    With a column ``space`` only fingerprints of the same space are compared.
    """
    space = [c for c in fps.columns if c == "space"]
    keys = [*space, "table", "kept"]
    masks = covering_masks(radius)
    level, found = _split(fps, masks, space), None
    while True:
        sizes = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        large = cut(sizes.where(F.col("n") > bucket).select(*keys))
        hot = not large.isEmpty() and max(64 - (m & (1 << 64) - 1).bit_count() for m in masks) > bucket.bit_length()
        small = level.join(large, keys, "left_anti") if hot else level
        lists = small.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        links = lists.select("fps").mapInArrow(_linked(radius, whole), "u long, v long")
        found = links if found is None else found.unionByName(links)
        if not hot:
            return found
        finer = {m: [m | b for b in _blocks(~m & (1 << 64) - 1, radius + 1)] for m in masks}
        members = level.join(large, keys, "left_semi")
        split = F.create_map(*[x for m, f in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(b)) for b in f]))])
        level = members.select(*space, "fp", F.explode(split[F.col("table")]).alias("table")).select(*space, "table", F.col("fp").bitwiseAND(F.col("table")).alias("kept"), "fp").distinct()
        masks = sorted({b for f in finer.values() for b in f})


def _links(marked: DataFrame, classes: DataFrame, radius: int, bucket: int, prints: int) -> DataFrame:
    """(u, v): links among first fingerprints, by any of the fingerprints."""
    if prints == 1:
        return link(classes.select("fp"), radius, bucket)
    spaces = F.posexplode(F.concat(F.array("fp"), "more")).alias("space", "value")
    # a fingerprint of a space stands for the least of the first ones that go with it
    members = cut(marked.select("fp", "more").distinct().select("fp", spaces))
    heads = cut(members.groupBy("space", "value").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")))
    same = members.join(heads.where("n > 1"), ["space", "value"]).where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    found = link(heads.select("space", F.col("value").alias("fp")), radius, bucket)
    of = lambda end: heads.groupBy(F.col("value").alias(end)).agg(F.min("head").alias(f"{end}_head"))
    near = found.join(of("u"), "u").join(of("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    return near.unionByName(same)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET, prints: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fingerprint (16 hex digits), component_id, a, b, root (of the class)."""
    marked = cut(fingerprints(docs, shingle, seed, prints))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(_links(marked, classes, radius, bucket, prints))
    labelled = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.select("fp", "root").join(least, "root")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "a", "b", "root")


def _grams(rows: DataFrame, words: int, seed: int) -> DataFrame:
    """rows (node, text) -> node, grams: the sorted different hashes of the text's shingles of ``words`` words."""

    def run(batches):
        for batch in _slices(batches):
            sets = [np.unique(shingle_hashes(t, words, seed)).view(np.int64) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), grams], names=["node", "grams"])

    return rows.mapInArrow(run, "node long, grams array<long>")


def _candidates(texts: DataFrame, radius: int, bucket: int) -> DataFrame:
    """texts (node, fp, more) -> (u, v), nodes with a fingerprint within the radius of each other: all such pairs where at most ``WHOLE`` fingerprints (or texts of one) meet, a spanning forest beyond."""
    members = cut(texts.select("node", F.posexplode(F.concat(F.array("fp"), "more")).alias("space", "value")))
    heads = cut(members.groupBy("space", "value").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")))
    crowded = members.join(heads.where(F.col("n") > WHOLE), ["space", "value"]).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    few = members.join(heads.where((F.col("n") > 1) & (F.col("n") <= WHOLE)), ["space", "value"]).groupBy("space", "value").agg(F.collect_list("node").alias("nodes"))
    both = F.flatten(F.transform("nodes", lambda x: F.transform(F.filter("nodes", lambda y: y < x), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    equal = few.select(F.explode(both).alias("e")).select("e.u", "e.v")
    found = link(heads.select("space", F.col("value").alias("fp")), radius, bucket, WHOLE)
    of = lambda end: heads.groupBy(F.col("value").alias(end)).agg(F.min("head").alias(f"{end}_head"))
    near = found.join(of("u"), "u").join(of("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    each = near.unionByName(crowded).unionByName(equal).where("u <> v")
    return each.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _overlap(n, similarity: float):
    """The fewest shingles that a set of n shares with any set of that similarity to it."""
    return np.maximum(np.ceil(similarity * n - 1e-9), 1).astype(np.int64)


def _in_question(docs: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """docs (doc_id, text) -> t1, a hash of each text that can have a partner of that similarity, or has no words.

    Two such texts share all but a few of their shingles, so of a text's least hashes (its prefix, ``SPARE`` of the set longer than one common hash takes) that share
    stands in another text's prefix too. Only prefixes are shuffled.
    """
    spare = lambda n: np.maximum(n // SPARE, 1)

    def run(batches):
        for batch in _slices(batches):
            sets = [np.unique(shingle_hashes(t, words, seed)) for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            # as long as the largest partner's test asks for
            take = np.minimum(n, n - _overlap(n, similarity) + spare((n / similarity + 1e-9).astype(np.int64) + 1))
            parts = [x[:k].view(np.int64) for x, k in zip(sets, take)]
            grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("t1"), pa.array(np.where(n > 0, np.minimum(spare(n), n), 0)), grams], names=["t1", "least", "grams"])

    lists = cut(docs.select(key128(F.col("text"))[0].alias("t1"), "text").mapInArrow(run, "t1 long, least long, grams array<long>"))
    # the one shuffle of prefixes deals them by hash; what leaves it are the shared ones
    same = Window.partitionBy("gram")
    each = lists.select("t1", "least", F.explode("grams").alias("gram")).withColumns({"x": F.min("t1").over(same), "y": F.max("t1").over(same)})
    found = each.where("x <> y").groupBy("t1").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).where("n >= least").select("t1")
    return found.unionByName(lists.where("least = 0").select("t1").distinct())


def _past(n, similarity: float):
    """The shingles of a set of n that stand behind its prefix."""
    return F.greatest(F.ceil(F.lit(similarity) * n - 1e-9), F.lit(1)) - 1


def _prefixes(grams: DataFrame, similarity: float) -> DataFrame:
    """grams (node, grams) -> gram, node, n, alone, place: each set's rarest shingles, as many as hold one of any partner's, with their places in the order (rarest first). ``alone``: the shingles that no other set has."""
    each = grams.select("node", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = each.join(often, "gram").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    length = F.col("n") - _past(F.col("n"), similarity)
    alone = F.col("n") - F.size("g")
    held = ordered.where(length > alone).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("g", F.lit(1), (length - alone).cast("int"))).alias("at", "e"))
    return held.select("e.gram", "node", "n", "alone", (F.col("alone") + F.col("at") + 1).alias("place"))


def _alike(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """pairs (u, v) of that similarity, compared exactly."""
    compared = pairs.join(grams.select(F.col("node").alias("u"), F.col("grams").alias("x")), "u").join(grams.select(F.col("node").alias("v"), F.col("grams").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return compared.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("u", "v")


def _all_links(grams: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links of that similarity that join all that belong together. ``known``: some links, already compared.

    Candidates share a shingle of their prefixes. Nodes are first compared with one node of each shingle only, in the first round the one with the least part of shingles of its own: near copies of one
    text have it in common and often little else. A pair in one class needs no comparison, and shingles of one class leave the rounds. These end when few pairs are left or a round no longer helps;
    all other pairs are then counted out by the shingles that their prefixes share, and those that may have the similarity are compared.
    """
    rows, total = cut_few(_prefixes(grams, similarity))
    links, before = known, None
    sizes = F.least("l.n", "r.n") >= similarity * F.greatest("l.n", "r.n") - 1e-9
    least = similarity / (1 + similarity) * (F.col("l.n") + F.col("r.n")) - 1e-9
    for k in range(HEAD_ROUNDS + 1):
        named = few(rows.select("gram", "node", "n", "alone", "place").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), total)
        each = few(named.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("n_root")), total).groupBy("gram").agg(F.sum("n_root").alias("members"), F.max(F.struct("n_root", "root")).alias("most"))
        mixed_grams = each.where(F.col("members") > F.col("most.n_root")).select("gram", F.col("most.root").alias("main"), "members")
        rows, total = cut_few(few(named.join(mixed_grams, "gram"), total))
        pairs, nodes = rows.where("root <> main").agg(F.sum("members"), F.count(F.lit(1))).first()
        if not nodes:
            return links
        if k == HEAD_ROUNDS or pairs <= FEW * nodes or (FEW and before and 2 * pairs > before):
            break
        before = pairs
        order = F.struct(F.col("alone") / F.col("n"), "node") if not k else F.xxhash64("node", F.lit(k))
        heads = rows.groupBy("gram").agg(F.min_by(F.struct("node", "n", "place", "root"), order).alias("h")).select("gram", "h.*")
        met = rows.alias("l").join(heads.alias("r"), F.expr("l.gram = r.gram AND l.root <> r.root"))
        near = sizes & (1 + F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place")) >= least)
        new, n_new = cut_few(few(met.where(near).select(F.greatest("l.node", "r.node").alias("u"), F.least("l.node", "r.node").alias("v")), total).distinct())
        links = cut_few(links.unionByName(few(_alike(new, grams, similarity), n_new)))[0]
    # each pair once a shared shingle; the bounds are of the sets, so that none is left out of the count
    once = F.expr("l.gram = r.gram AND l.root <> r.root AND (r.root = r.main OR l.node < r.node)")
    met = rows.where("root <> main").alias("l").join(rows.alias("r"), once & sizes & (F.least(F.col("l.n") - F.col("l.alone"), F.col("r.n") - F.col("r.alone")) >= least))
    # of the set whose prefix ends first, what lies before that end is counted
    lacks = F.ceil(least - F.greatest(_past(F.col("l.n"), similarity), _past(F.col("r.n"), similarity)))
    counted = met.select(F.greatest("l.node", "r.node").alias("u"), F.least("l.node", "r.node").alias("v"), lacks.alias("lacks")).groupBy("u", "v", "lacks").agg(F.count(F.lit(1)).alias("shared"))
    left, n_left = cut_few(counted.where("shared >= lacks").select("u", "v"))
    return cut_few(links.unionByName(few(_alike(left, grams, similarity), n_left)))[0]


def confirmed_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET, prints: int = 1) -> DataFrame:
    """As ``near_duplicates``, but different texts are linked if, and only if, their sets of ``words``-word shingles have that Jaccard similarity.

    Equal texts count once. The covering tables give pairs of texts whose shingles are compared exactly; a join of the rarest shingles of each text then gives every further
    pair of that similarity whose texts are not in one class yet (``_all_links``). Two texts without words are alike.
    """
    marked = cut(fingerprints(docs, shingle, seed, prints)).withColumn("row", F.monotonically_increasing_id())
    texts = cut(marked.groupBy("t1", "t2").agg(F.min(F.struct("row", "a", "b")).alias("r"), F.first("fp").alias("fp"), F.first("more").alias("more")).select("t1", "t2", F.col("r.row").alias("node"), "r.a", "r.b", "fp", "more"))
    asked = cut(texts.join(_in_question(docs, similarity, words, seed), "t1", "left_semi"))
    a, b = key128(F.col("doc_id"), F.col("text"))
    rows = docs.select("text", a.alias("__a"), b.alias("__b")).join(_keyed(asked.select("node", F.col("a").alias("__a"), F.col("b").alias("__b"))), ["__a", "__b"]).select("node", "text")
    grams = cut(_grams(rows, words, seed).dropDuplicates(["node"]))
    blank = grams.where(F.size("grams") == 0).select(F.col("node").alias("u"))
    known = _alike(_candidates(asked, radius, bucket), grams, similarity).unionByName(blank.crossJoin(F.broadcast(blank.agg(F.min("u").alias("v")))).where("u <> v"))
    roots = components(_all_links(grams, cut_few(known)[0], similarity))
    labelled = texts.join(roots, "node", "left").select("t1", "t2", F.coalesce("root", "node").alias("root"))
    named = marked.join(labelled, ["t1", "t2"])
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "a", "b", "root")


def _keyed(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def one_of_each(docs: DataFrame, similarity: float | None = None, **options) -> DataFrame:
    """docs without the rows whose class has a row with a smaller doc_id (equal rows: one stays). With ``similarity`` links are confirmed by it."""
    with shuffles_freed(docs.sparkSession):
        return _one_of_each(docs, similarity, options)


def _one_of_each(docs: DataFrame, similarity: float | None, options: dict) -> DataFrame:
    classes = cut(near_duplicates(docs, **options) if similarity is None else confirmed_duplicates(docs, similarity, **options))
    stay = classes.groupBy("root").agg(F.min(F.struct("doc_id", "a", "b")).alias("s")).select("s.a", "s.b")
    gone = cut(classes.select("a", "b").distinct().join(stay, ["a", "b"], "left_anti"))
    again = cut(classes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b").join(stay, ["a", "b"], "left_semi"))
    a, b = key128(F.col("doc_id"), F.col("text"))
    rows = docs.withColumns({"__a": a, "__b": b})

    def keyed(keys):
        return _keyed(keys.select(F.col("a").alias("__a"), F.col("b").alias("__b")))

    left = rows.join(keyed(gone), ["__a", "__b"], "left_anti")
    if not again.isEmpty():
        left = left.join(keyed(again), ["__a", "__b"], "left_anti").unionByName(left.join(keyed(again), ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"]))
    return left.select(*docs.columns)
