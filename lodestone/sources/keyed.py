"""Tables of rows by key, in hash partitions, edited in place.

A row lies in partition ``part`` = hash of its key modulo ``parts``. An edit reads and rewrites the partitions of the keys it
touches (dynamic partition overwrite) and leaves all other files as they are, so its cost follows the edit and not the
table. Spark writes the new files beside the old ones and exchanges them when the job commits; an edit that failed is run again: every edit here
gives the same table when it is run twice. Deleted rows stay as marks until their partition is rewritten next, so that a
partition without rows is overwritten too. One writer at a time. Keys may be null: they are equal to each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import newest

PART, LIVE = "part", "live"
#: Rows in one file of a partition.
FILE_ROWS = 5_000_000


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    keys: list[str]
    schema: str
    parts: int = 64

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _live(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {LIVE} boolean, {PART} int").parquet(self.path).where(LIVE).drop(LIVE)

    def read(self) -> DataFrame:
        return self._live().drop(PART)

    def _new(self, rows: DataFrame, order: str | None) -> DataFrame:
        """One row of each key with its partition: the newest by ``order``; without one the greatest by its columns, so that a second run chooses alike."""
        rows, columns = rows.select(*self.columns), self.columns
        if order:
            rows = newest(rows, self.keys, order)
        else:
            rest = [c for c in columns if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("r")).select(*self.keys, "r.*") if rest else rows.distinct()
        return rows.select(*columns, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int").alias(PART))

    def _write(self, live: DataFrame, gone: DataFrame | None = None, mode: str = "dynamic") -> None:
        rows = live.withColumn(LIVE, F.lit(True))
        if gone is not None:
            rows = rows.unionByName(gone.withColumn(LIVE, F.lit(False)))
        writer = rows.repartition(self.parts, PART).write.partitionBy(PART).option("maxRecordsPerFile", FILE_ROWS)
        writer.option("partitionOverwriteMode", mode).mode("overwrite").parquet(self.path)

    def _touched(self, dealt: DataFrame) -> list[int]:
        return sorted(r[PART] for r in dealt.select(PART).distinct().collect())  # at most ``parts``

    def _same_key(self, a: DataFrame, b: DataFrame) -> Column:
        out = a[PART] == b[PART]
        for k in self.keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    def create(self, rows: DataFrame, order: str | None = None) -> None:
        """The table anew (a forced load): all former rows go."""
        self._write(self._new(rows, order), mode="static")

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows replace those of their key, others are added. The number of partitions rewritten, as of every edit."""
        return self.replace(F.lit(False), rows, order)

    def insert_missing(self, rows: DataFrame, order: str | None = None) -> int:
        """Adds only rows whose key is not there yet."""
        new, live = self._new(rows, order), self._live()
        fresh = new.join(live.select(PART, *self.keys), self._same_key(new, live), "left_anti")
        touched = self._touched(fresh)
        if touched:
            self._write(live.where(F.col(PART).isin(touched)).unionByName(fresh))
        return len(touched)

    def update(self, condition: Column, changes: dict[str, Column]) -> int:
        """A guarded update of columns that are no keys; partitions without a row that meets the guard stay as they are."""
        if set(changes) & set(self.keys):
            raise ValueError("keys are not updated: replace the rows")
        hit = F.coalesce(condition, F.lit(False))
        touched = self._touched(self._live().where(hit))
        if touched:
            old = self._live().where(F.col(PART).isin(touched))
            self._write(old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).select(*old.columns))
        return len(touched)

    def replace(self, condition: Column, rows: DataFrame | None = None, order: str | None = None) -> int:
        """Delete what meets the condition and upsert the rows, in one write."""
        gone = F.coalesce(condition, F.lit(False))
        new = self._new(rows if rows is not None else self.spark.createDataFrame([], self.schema), order)
        touched = sorted({*self._touched(self._live().where(gone)), *self._touched(new)})
        if touched:
            old = self._live().where(F.col(PART).isin(touched))
            kept = old.where(~gone)
            kept = kept.join(new.select(PART, *self.keys), self._same_key(kept, new), "left_anti").unionByName(new)
            self._write(kept, old.where(gone))
        return len(touched)


def load(rows: DataFrame, path: str, force: bool = False, per_file: int = FILE_ROWS) -> None:
    """A plain load in files of at most ``per_file`` rows: added to what is there, or in place of it."""
    rows.write.option("maxRecordsPerFile", per_file).mode("overwrite" if force else "append").parquet(path)
