"""Typed tables, key lookups, upserts and guarded edits.

Parquet tables have no MERGE: an edit is an anti join and a union, written to a new folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "chunks": "id long, section_no int, section_title string, paragraph_id string, content_type string, table_no string, figure_no string, page_start int, page_end int, content string, embedding array<float>, created_at timestamp",
    "formulas": "code string, title string, section_no int, paragraph_id string, page_no int, expression string, variables string, result_unit string, notes string, verified boolean",
    "rules": "rule_id int, topic string, parameter string, value_text string, value_num double, unit string, section_no int, paragraph_id string, page_no int, source_quote string, trigger_terms array<string>, context_note string, verified boolean, verified_by string, verified_at timestamp, value_text_en string, value_text_id string",
    "condense_cache": "query_hash string, normalized_query string, language string, mode string, condense_version int, en_query string, created_at timestamp",
}
CONTENT_TYPES = ("narrative", "table", "formula", "figure")


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A table with its declared schema, never an inferred one."""
    return spark.read.schema(SCHEMAS[kind]).parquet(path)


def checked_chunks(chunks: DataFrame, dimension: int | None = None) -> DataFrame:
    """chunks, or an error at run time for an unknown type or a vector of the wrong length."""
    bad = ~F.col("content_type").isin(*CONTENT_TYPES) | F.col("content_type").isNull()
    if dimension:
        bad = bad | (F.col("embedding").isNotNull() & (F.size("embedding") != dimension))
    return chunks.withColumn("content_type", F.when(bad, F.raise_error(F.lit("chunk breaks a constraint"))).otherwise(F.col("content_type")))


def verified(table: DataFrame, **equal) -> DataFrame:
    """Verified rows, filters left to the scan."""
    out = table.where("verified")
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out


def look_up(queries: DataFrame, cache: DataFrame, key: str, version: int | None = None) -> DataFrame:
    """queries with the cached columns of their key, null on a miss."""
    if version is not None:
        cache = cache.where(F.col("condense_version") == version)
    keep = [key, *[c for c in cache.columns if c not in queries.columns]]
    return queries.join(cache.select(*keep), key, "left")


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; a max of structs combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with its rows of the same key replaced; of several new rows of a key the greatest by its other columns stays. ``keyed.KeyedTable`` edits in place."""
    rest = [c for c in table.columns if c not in keys]
    new = rows.select(*table.columns)
    new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*table.columns) if rest else new.distinct()
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_where(table: DataFrame, condition, rows: DataFrame) -> DataFrame:
    """Delete, then insert."""
    return table.where(~F.coalesce(condition, F.lit(False))).unionByName(rows.select(*table.columns))


def guarded_update(table: DataFrame, condition, changes: dict) -> DataFrame:
    """Changes columns only where the guard holds; applying it twice changes nothing more."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def alive(table: DataFrame) -> bool:
    """Whether a row can be read."""
    return bool(table.limit(1).take(1))


def numbered(rows: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """Identity column by an order; for small tables only (one window)."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + F.lit(start - 1))


def write(table: DataFrame, path: str, mode: str = "append") -> None:
    table.write.mode(mode).parquet(path)


def entries_from_yaml(spark: SparkSession, text: str, schema: str, ids: list[str] | None = None) -> DataFrame:
    """Evaluation entries from YAML, or from JSON where no YAML library is installed."""
    try:
        import yaml

        rows = yaml.safe_load(text)
    except ImportError:
        rows = json.loads(text)
    out = spark.createDataFrame(rows or [], schema)
    return out.where(F.col("id").isin(ids)) if ids else out
