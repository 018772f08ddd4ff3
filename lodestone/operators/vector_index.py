"""Stored vector index: cells of a coarse quantiser as partitions, residuals as product-quantised codes.

``fit`` learns the quantisers on a bounded sample of the rows (``SAMPLE_BYTES`` at most), on unit vectors, and calibrates on it how
many cells a search must visit and how many candidates it must check for the asked share of the true neighbours. ``store`` writes every row: its cell, and a code of one byte
for each ``DIMENSIONS`` components of what the cell's centre leaves over. A file's row is a block of up to ``BLOCK`` vectors of one cell; a crowded cell has many
blocks, in files of bounded size. ``search`` sends each query's nearest cells to the index: a join on the partition
column, so that Spark prunes the partitions at run time. A task keeps a bounded number of candidates a query, by a blockwise product with the decoded vectors;
the best candidates are then scored exactly on the vectors themselves.

Null, zero and non-finite vectors, and those of another length than the sample's, are not indexed and find nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from .retrieval import ranked

SAMPLE_BYTES, SAMPLE_ROWS, DIMENSIONS, CODES, BLOCK, ROUNDS, CALIBRATION = 64 << 20, 50_000, 4, 256, 4096, 12, 200
#: Vectors of a cell in one file, and queries in a block.
FILE_ROWS, QUERY_BLOCK = 1 << 20, 256
#: Candidates that a task holds.
HELD = 4_000_000
#: Measured bytes of probes up to which they are broadcast; beyond, they are dealt by cell.
BROADCAST_BYTES = 64 << 20


@dataclass
class Quantisers:
    centres: np.ndarray  # cells x d
    books: np.ndarray  # parts x codes x width
    probes: int
    candidates: int

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of unit vectors."""
        cell = _nearest(x, self.centres)
        rest = (x - self.centres[cell]).reshape(len(x), len(self.books), -1)
        return cell, np.stack([_nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, cell, codes: np.ndarray) -> np.ndarray:
        rest = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return self.centres[cell] + rest

    def to_json(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "books": self.books.tolist(), "probes": self.probes, "candidates": self.candidates})

    @staticmethod
    def from_json(text: str) -> Quantisers:
        x = json.loads(text)
        return Quantisers(np.array(x["centres"]), np.array(x["books"]), x["probes"], x["candidates"])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    bias, out = (centres**2).sum(axis=1) / 2, np.empty(len(x), dtype=np.int64)
    for a in range(0, len(x), BLOCK):
        out[a : a + BLOCK] = np.argmax(x[a : a + BLOCK] @ centres.T - bias, axis=1)
    return out


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means of the rows (k or fewer centres)."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty cell starts anew
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def _usable(column: str, dimension: int | None = None):
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0 if dimension is None else F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0)


def unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True)) if len(x) else x


def fit(chunks: DataFrame, k: int = 10, recall: float = 0.98, cells: int | None = None, seed: int = 7) -> Quantisers:
    """chunks (id, embedding) -> quantisers. ``cells``: about the root of the rows if not given."""
    usable = chunks.where(_usable("embedding")).select("id", "embedding")
    n, width, narrow = usable.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.min(F.size("embedding"))).first()
    if not n:
        raise ValueError("no vector to learn from")
    if width != narrow:
        raise ValueError(f"vectors of {narrow} to {width} components: index each length apart")
    most = max(1000, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    share = min(1.0, most / n)
    some = usable.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * most)
    x = unit([r["embedding"] for r in some.collect()])
    centres = _means(x, cells or max(1, round(n**0.5 / 2)), seed)
    parts = next(p for p in range(max(1, width // DIMENSIONS), 0, -1) if width % p == 0)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
    size = min(CODES, len(x))
    made = Quantisers(centres, np.stack([_means(rest[:, p], size, seed + p) for p in range(parts)]), 1, k)
    return _calibrated(made, x, k, recall)


def _calibrated(made: Quantisers, x: np.ndarray, k: int, recall: float) -> Quantisers:
    """With as many cells and candidates as the share ``recall`` of the sample's own true neighbours needs.

    In the whole table a neighbour stands behind more rows than in the sample, by their ratio; candidates are at least four times k.
    """
    asked = x[:: max(1, len(x) // CALIBRATION)][:CALIBRATION]
    cell, codes = made.encode(x)
    decoded = made.decode(cell, codes)
    exact, coarse = asked @ x.T, asked @ decoded.T
    true = np.argsort(-exact, axis=1, kind="stable")[:, 1 : k + 1]
    if not true.size:
        return made
    order = np.argsort(np.argsort(_distances(asked, made.centres), axis=1, kind="stable"), axis=1)  # a cell's place for each query
    cells = np.take_along_axis(order, cell[true], axis=1)
    places = np.argsort(np.argsort(-coarse, axis=1, kind="stable"), axis=1)
    behind = np.take_along_axis(places, true, axis=1)
    at = lambda found: int(np.quantile(found, recall + (1 - recall) / 2, method="higher"))  # noqa: E731  both losses together stay in the share
    return Quantisers(made.centres, made.books, 1 + at(cells), max(4 * k, 2 * (1 + at(behind))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b**2).sum(axis=1)[None, :] - 2 * a @ b.T


def store(chunks: DataFrame, made: Quantisers, path: str) -> None:
    """Write all usable rows (id, embedding) to ``path``, partitioned by cell, and the quantisers beside them."""
    spark = chunks.sparkSession

    def coded(batches):
        for batch in batches:
            cell, codes = made.encode(unit(batch.column("embedding").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "code"])

    rows = chunks.where(_usable("embedding", made.dimension)).select(F.col("id").cast("long").alias("id"), "embedding")
    rows = rows.where("id IS NOT NULL").mapInArrow(coded, "cell int, id long, code binary")
    files = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-chunks.count() // FILE_ROWS))))  # as if all rows were of one cell

    def packed(batches):
        held: dict[int, list] = {}

        def block(cell):
            ids, codes = zip(*held.pop(cell))
            return pa.RecordBatch.from_arrays([pa.array([list(ids)], pa.list_(pa.int64())), pa.array([b"".join(codes)], pa.binary()), pa.array([cell], pa.int32())], names=["ids", "codes", "cell"])

        for batch in batches:  # sorted by cell, so one is open
            for cell, i, code in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "code"))):
                if held and cell not in held:
                    yield block(next(iter(held)))
                held.setdefault(cell, []).append((i, code))
                if len(held[cell]) == BLOCK:
                    yield block(cell)
        for cell in list(held):
            yield block(cell)

    blocks = rows.withColumn("file", files).repartition("cell", "file").sortWithinPartitions("cell", "id").select("cell", "id", "code")
    blocks.mapInArrow(packed, "ids array<long>, codes binary, cell int").write.partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(made.to_json(),)], "quantisers string").coalesce(1).write.parquet(f"{path}/model")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, Quantisers]:
    """The cells' blocks and the quantisers of a folder."""
    made = Quantisers.from_json(spark.read.parquet(f"{path}/model").first()["quantisers"])
    return spark.read.schema("ids array<long>, codes binary, cell int").parquet(f"{path}/cells"), made


def probes_of(queries: DataFrame, made: Quantisers, probes: int) -> DataFrame:
    """queries (query_id, query_vector) -> (cell, place, query_id, vector): the nearest cells of each."""
    n = min(probes, len(made.centres))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("query_vector").to_pylist())
            near = np.argsort(_distances(x, made.centres), axis=1, kind="stable")[:, :n]
            ids = batch.column("query_id").to_pylist()
            cells, places = near.ravel().astype(np.int32), np.tile(np.arange(n, dtype=np.int32), len(ids))
            whole = pa.array([v for v in x.tolist() for _ in range(n)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(places), pa.array(np.repeat(np.array(ids, dtype=np.int64), n)), whole], names=["cell", "place", "query_id", "vector"])

    usable = queries.where(_usable("query_vector", made.dimension) & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "query_vector")
    return usable.mapInArrow(run, "cell int, place int, query_id long, vector array<double>").where(F.col("place") < n)


def candidates(blocks: DataFrame, made: Quantisers, queries: DataFrame, probes: int, keep: int) -> DataFrame:
    """(query_id, id, score): the ``keep`` best of each query by decoded vectors, among the cells it visits."""
    n = queries.count()
    asked = probes_of(queries, made, probes).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERY_BLOCK)))))
    packed = asked.groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "vector")).alias("asked")).drop("block")
    if n * probes * made.dimension * 8 <= BROADCAST_BYTES:
        packed = F.broadcast(packed)

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def given():
            while best:
                query_id, (s, i) = best.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([query_id] * len(i), pa.int64()), pa.array(i), pa.array(s)], names=["query_id", "id", "score"])

        for batch in batches:
            for at_row in range(batch.num_rows):  # a row is a block of vectors and one of queries; as Python objects a whole batch would be many times its size
                ids, asked_of = (batch.column(c)[at_row].values for c in ("ids", "asked"))
                ids, codes = ids.to_numpy(zero_copy_only=False), np.frombuffer(batch.column("codes")[at_row].as_buffer(), np.uint8).reshape(len(ids), -1)
                decoded = made.decode(np.full(len(ids), batch.column("cell")[at_row].as_py()), codes)
                vectors_of = asked_of.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(asked_of), -1)
                for a in range(0, len(vectors_of), QUERY_BLOCK):
                    for query_id, row in zip(asked_of.field("query_id")[a : a + QUERY_BLOCK].to_pylist(), vectors_of[a : a + QUERY_BLOCK] @ decoded.T):
                        at = np.argpartition(-row, keep)[:keep] if len(row) > keep else slice(None)
                        s, i = row[at], ids[at]
                        if query_id in best:
                            s, i = np.concatenate([best[query_id][0], s]), np.concatenate([best[query_id][1], i])
                        first = np.lexsort((i, -s))[:keep]
                        best[query_id] = s[first], i[first]
                if len(best) * keep > HELD:  # what is given early meets the rest in the ranking
                    yield from given()
        yield from given()

    found = blocks.join(packed, "cell").select("ids", "codes", "cell", "asked").mapInArrow(run, "query_id long, id long, score double")
    return ranked(found, "score", keep).drop("rank")


def search(path: str, chunks: DataFrame, queries: DataFrame, k: int, probes: int | None = None, keep: int | None = None) -> DataFrame:
    """Index at ``path``, chunks (id, embedding), queries (query_id, query_vector) -> query_id, rank, id, distance (cosine, rounded to six places).

    A query's own row is not left out. All cells and as many candidates as rows give the exact result.
    """
    blocks, made = open_store(chunks.sparkSession, path)
    near = candidates(blocks, made, queries, probes or made.probes, max(k, keep or made.candidates)).select("query_id", "id")
    exact = chunks.join(near, "id").join(queries.select(F.col("query_id").cast("long").alias("query_id"), "query_vector"), "query_id")
    scored = exact.select("query_id", "id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("query_vector")), 6).alias("distance"))
    return ranked(scored, "distance", k, ascending=True).select("query_id", "rank", "id", "distance")
