"""Folders and tables that a session writes for itself, in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a task packs at a time.
PACK_BYTES = 48_000_000


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if named is None and not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='shared-')}/{kind}-{uuid.uuid4().hex}"


def _packed(batches):
    """Batches (..., bucket) -> (bucket, packed): the rows of one bucket, compressed column by column, in order."""

    def flushed(held):
        rows = pa.concat_batches(held)
        buckets = rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False)
        order = np.argsort(buckets, kind="stable")
        rows, buckets = rows.select(range(rows.num_columns - 1)).take(pa.array(order)), buckets[order]
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        blobs = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)]):
            columns = [c.dictionary_encode() if pa.types.is_string(c.type) else c for c in rows.slice(a, b - a).columns]
            part, sink = pa.RecordBatch.from_arrays(columns, names=rows.schema.names), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(buckets[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield flushed(held)
            held, size = [], 0
    if held:
        yield flushed(held)


def _unpacked(batches):
    for batch in batches:
        for blob in batch.column(1):
            for rows in pa.ipc.open_stream(blob.as_buffer()):
                columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in rows.columns]
                yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)


def deal(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Rows in the partition of their hash bucket of the keys. Many small rows are shuffled as few packed ones: a fraction of the disk."""
    schema, place = rows.schema, F.pmod(F.hash(*keys), F.lit(buckets)).alias("__bucket")
    packs = rows.select("*", place).mapInArrow(_packed, "bucket int, packed binary")
    return packs.repartitionById(buckets, "bucket").mapInArrow(_unpacked, schema)


def save_bucketed(rows: DataFrame, path: str, keys: list[str], buckets: int, merged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write rows as a table in hash buckets of the keys, one file a bucket, sorted by them (once, as they are written); the table.

    Joins and groupings on the keys then read it without a shuffle. ``merged``, if given, makes the table's rows of the dealt ones, by a grouping that starts with the keys.
    """
    spark, name = rows.sparkSession, f"stored_{uuid.uuid4().hex}"
    dealt = merged(rows.repartition(buckets, *keys)) if merged else deal(rows, keys, buckets)
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """The table of an earlier session, by its path."""
    name, by = f"stored_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
