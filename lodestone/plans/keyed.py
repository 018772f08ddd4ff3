"""Queries of keyed tables over ``orders``: edits in place, the table afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from ..sources.stored import shared_folder
from .base import query, table

SCHEMA = "o_orderkey long, o_orderstatus string, o_totalprice double"


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def first_load(spark, sf_dir):
    made = KeyedTable(spark, shared_folder(spark, "keyed"), ["o_orderkey"], SCHEMA, parts=32)
    made.create(orders(spark, sf_dir).where("o_orderkey % 3 <> 0"))
    return made


_ORDERS = "SELECT o_orderkey::BIGINT AS o_orderkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice FROM orders"


@query(
    "keyed_upsert",
    f"""WITH o AS ({_ORDERS}), n AS (SELECT o_orderkey, 'U' AS o_orderstatus, o_totalprice + 2 AS o_totalprice FROM o WHERE o_orderkey % 50 < 2)
        SELECT * FROM o WHERE o_orderkey % 3 <> 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n""",
)
def keyed_upsert(spark, sf_dir):
    """Two versions of each new row; the newest by price counts."""
    made = first_load(spark, sf_dir)
    some = orders(spark, sf_dir).where("o_orderkey % 50 < 2").withColumn("o_orderstatus", F.lit("U"))
    made.upsert(some.withColumn("by", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("o_totalprice", F.col("o_totalprice") + F.col("by")), "o_totalprice")
    return made.read()


@query(
    "keyed_replace",
    f"""WITH o AS ({_ORDERS}), n AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice FROM o WHERE o_orderkey % 40 = 0),
        r AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 7 = 0) AND o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n)
        SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 AND o_orderstatus = 'O' THEN 'checked' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM r""",
)
def keyed_replace(spark, sf_dir):
    """Delete, insert, then a guarded update, all run twice."""
    made = first_load(spark, sf_dir)
    for _ in range(2):
        made.replace(F.col("o_orderkey") % 7 == 0, orders(spark, sf_dir).where("o_orderkey % 40 = 0").withColumn("o_orderstatus", F.lit("N")))
        made.update((F.col("o_orderkey") % 11 == 0) & (F.col("o_orderstatus") == "O"), {"o_orderstatus": F.lit("checked")})
    return made.read()
