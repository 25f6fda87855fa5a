"""Feature contract, scaling, validation and decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions import decide


@dataclass(frozen=True)
class FeatureSpec:
    """Named feature contract: columns are resolved by name, never position.

    ``scaled`` columns are standardised and come first in pipeline order, the
    other features pass through in their original relative order.
    """

    features: tuple[str, ...]
    scaled: tuple[str, ...] = ()
    label: str = "label"
    order_col: str | None = None
    id_cols: tuple[str, ...] = field(default_factory=tuple)

    def pipeline_order(self) -> list[str]:
        return [*self.scaled, *[f for f in self.features if f not in self.scaled]]


def select_features(df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *spec.features)


def select_by_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def filter_class(df: DataFrame, value: int, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == value)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and *population* std per column from one aggregation (2 numbers per
    column reach the driver).  A constant column gets divisor 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        out[c] = (float(m) if m is not None else 0.0, float(s) if s else 1.0)
    return out


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """(x - mean) / std as literal arithmetic (stays in codegen, no join)."""
    out = df
    for c, (m, s) in params.items():
        out = out.withColumn(f"{c}{suffix}", (F.col(c) - F.lit(m)) / F.lit(s))
    return out


def standard_scale(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None, suffix: str = "") -> DataFrame:
    return apply_scaler(df, fit_scaler(fit_df if fit_df is not None else df, cols), suffix)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Matrix column for MLlib learners, in the given (pipeline) order."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def decisions(df: DataFrame, threshold: float, score: str = "score", out: str = "decision") -> DataFrame:
    return df.withColumn(out, decide(score, threshold))


def validate_contract(df: DataFrame, features: Sequence[str], id_cols: Sequence[str] = ()) -> DataFrame:
    """Every feature required and numeric: try_cast to double, null / NaN /
    non-numeric text becomes a named reason.  Returns the typed features plus
    ``reasons`` (array of failing column names) and ``is_valid``; extra columns
    are ignored.  Split with ``valid_rows`` / ``rejected_rows``."""
    typed = [F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in features]
    t = df.select(*id_cols, *typed)
    bad = [F.when(F.col(c).isNull() | F.isnan(F.col(c)), F.lit(c)) for c in features]
    t = t.withColumn("reasons", F.filter(F.array(*bad), lambda x: x.isNotNull()))
    return t.withColumn("is_valid", F.size("reasons") == 0)


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where("is_valid").drop("reasons", "is_valid")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where("NOT is_valid")
