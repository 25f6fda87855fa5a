"""Derived views the registered queries run on, in Spark and in DuckDB SQL.

The reference works on one scored transaction table (label + model score) and
one event stream.  The driver tables are bridged as follows:

* ``scored``  (from lineitem, every row): an integer score mix ``sm`` gives a
  monotone but mis-calibrated ``score = sm / 1000`` and a label drawn by an
  integer hash, so both engines compute bit-identical values.
* ``events_scored`` (from events, every row): label = an error event above 50,
  score = value / (value + 50); epoch milliseconds for windows.
* ``matrix`` (from embeddings, every row): 64 float features, label = class 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.functions import epoch_micros
from costlens.sources import read_table

# Unique row key of the scored view, in tie-break order after the time column.
SCORED_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "time_us"]
SCORED_ID_SQL = ", ".join(SCORED_ID)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    sm = F.col("l_quantity").cast("int") * 13 + F.floor("l_extendedprice").cast("bigint") % 350
    hashed = ((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729) % 1000) * 5000
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        epoch_micros("l_shipdate").alias("time_us"),
        F.col("l_returnflag").alias("segment"),
        (sm / F.lit(1000.0)).alias("score"),
        F.when(hashed < sm * sm, 1).otherwise(0).alias("label"),
    )


SCORED_SQL = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
         epoch_us(l_shipdate) AS time_us, l_returnflag AS segment,
         sm / 1000.0::DOUBLE AS score,
         CASE WHEN ((l_partkey * 7919 + l_orderkey * 104729) % 1000) * 5000 < sm * sm THEN 1 ELSE 0 END AS label
  FROM (SELECT *, CAST(l_quantity AS INTEGER) * 13 + CAST(floor(l_extendedprice) AS BIGINT) % 350 AS sm
        FROM lineitem) s
)"""


def events_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "ts",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("ms"),
        "user_id",
        "event_type",
        "value",
        ((F.col("event_type") == "error") & (F.col("value") > 50)).cast("int").alias("label"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("score"),
    )


EVENTS_SQL = """
events_scored AS (
  SELECT event_id, ts, epoch_us(ts) // 1000 AS ms, user_id, event_type, value,
         CASE WHEN event_type = 'error' AND value > 50 THEN 1 ELSE 0 END AS label,
         value / (value + 50.0::DOUBLE) AS score
  FROM events
)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        (F.col("label") == 0).cast("int").alias("label"),
    )


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
