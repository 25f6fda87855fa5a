"""Sources and sinks: CSV ingest, split persistence, JSON event encoding.

Schemas are explicit (no inference pass over the data).  Outputs go to the
shared folder the cluster configures (``spark.checkpoint.dir``) or to a path
the caller names; writes are whole-folder overwrites, so a retried job leaves
no partial state behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def transaction_schema(features: Sequence[str], label: str | None = "label", label_type=T.IntegerType()) -> T.StructType:
    """All features double (+ integer label): the contract of the raw table."""
    fields = [T.StructField(c, T.DoubleType(), True) for c in features]
    if label:
        fields.append(T.StructField(label, label_type, True))
    return T.StructType(fields)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_transactions_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with an explicit schema; malformed rows fail the job (FAILFAST)."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_split(df: DataFrame, path: str, part_col: str = "part") -> str:
    """One parquet dataset partitioned by split part (train/test or fit/calib/test)."""
    df.write.mode("overwrite").partitionBy(part_col).parquet(path)
    return path


def load_split(spark: SparkSession, path: str, part: str, columns: Sequence[str], part_col: str = "part") -> DataFrame:
    """Read one part by name; the partition filter prunes directories and only
    ``columns`` are read from the files."""
    return spark.read.parquet(path).where(F.col(part_col) == part).select(*columns)


def encode_events(df: DataFrame, features: Sequence[str], key: str | None = None, out: str = "payload") -> DataFrame:
    """One JSON object per row, every feature as a double, label dropped."""
    body = F.to_json(F.struct(*[F.col(c).cast("double").alias(c) for c in features]))
    return df.select(*([key] if key else []), body.alias(out))


def decode_events(df: DataFrame, schema: T.StructType, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """JSON text -> typed columns.  ``_corrupt`` is true for text that is no JSON object of the schema, wholly or in a
    field (what could be read is kept, the rest is null), and for a null payload: a rejected side output, not a failed
    job.  A valid record whose fields are null or absent is not corrupt."""
    mark = "_malformed"
    full = T.StructType([*schema.fields, T.StructField(mark, T.StringType())])
    parsed = F.from_json(F.col(payload), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark})
    out = df.select(*keep, parsed.alias("_e"), F.col(payload))
    fields = [F.col(f"_e.{f.name}").alias(f.name) for f in schema.fields]
    return out.select(*keep, *fields, (F.col("_e").isNull() | F.col(f"_e.{mark}").isNotNull()).alias("_corrupt"))
