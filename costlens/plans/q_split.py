"""Registered split / sampling / feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.functions import portable_hash_sql
from costlens.operators import features, sampling, split
from costlens.plans.registry import register
from costlens.plans.views import EVENTS_SQL, SCORED_ID, SCORED_SQL, events_scored, scored, with_sql

ORDER = ["time_us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
ORDER_SQL = ", ".join(ORDER)
KEYS = [*SCORED_ID, "label"]
KEYS_SQL = ", ".join(KEYS)

_RN_SQL = f"""r AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS rn, count(*) OVER () AS n FROM scored)"""
_K_TRAIN = "CAST(floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT)"
_K_FIT = f"CAST(floor({_K_TRAIN} * (1.0::DOUBLE - 0.15::DOUBLE)) AS BIGINT)"
_SPLIT2_SQL = f"""split AS (SELECT *, CASE WHEN rn <= {_K_TRAIN} THEN 'train' ELSE 'test' END AS part FROM r)"""
_SPLIT3_SQL = f"""split3 AS (SELECT *, CASE WHEN rn <= {_K_FIT} THEN 'fit' WHEN rn <= {_K_TRAIN} THEN 'calib' ELSE 'test' END AS part FROM r)"""


def split2(spark, sf):
    return split.chronological_split(scored(spark, sf), "time_us", ORDER[1:], 0.2)


def split3(spark, sf):
    return split.three_way_split(scored(spark, sf), "time_us", ORDER[1:], 0.2, 0.15)


@register("chronological_split", with_sql(SCORED_SQL, _RN_SQL, _SPLIT2_SQL, body=f"SELECT {KEYS_SQL}, part FROM split"))
def q_chronological_split(spark, sf):
    return split2(spark, sf).select(*KEYS, "part")


@register("three_way_split", with_sql(SCORED_SQL, _RN_SQL, _SPLIT3_SQL, body=f"SELECT {KEYS_SQL}, part FROM split3"))
def q_three_way_split(spark, sf):
    return split3(spark, sf).select(*KEYS, "part")


@register(
    "split_summary",
    with_sql(
        SCORED_SQL, _RN_SQL, _SPLIT3_SQL,
        body="SELECT part, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive FROM split3 GROUP BY part",
    ),
)
def q_split_summary(spark, sf):
    return split.split_summary(split3(spark, sf))


_EV_HASH = portable_hash_sql(0, "event_id")
_EV_COUNTS = """c AS (SELECT CAST(sum(label) AS BIGINT) AS p, count(*) - CAST(sum(label) AS BIGINT) AS q FROM events_scored)"""
_EV_NEG = f"""neg AS (SELECT event_id, label, row_number() OVER (ORDER BY {_EV_HASH}, event_id) AS rn
  FROM events_scored WHERE label <> 1)"""


@register(
    "undersample_majority",
    with_sql(
        EVENTS_SQL, _EV_COUNTS, _EV_NEG,
        body="""SELECT event_id, label FROM events_scored WHERE label = 1
UNION ALL SELECT event_id, label FROM neg WHERE rn <= (SELECT least(20 * p, q) FROM c)""",
    ),
)
def q_undersample_majority(spark, sf):
    ev = events_scored(spark, sf).select("event_id", "label")
    return sampling.undersample_majority(ev, ["event_id"], ratio=20, seed=0)


@register(
    "capped_sample",
    with_sql(
        EVENTS_SQL, _EV_COUNTS, _EV_NEG,
        body="""SELECT event_id, label FROM events_scored WHERE label = 1
UNION ALL SELECT event_id, label FROM neg WHERE rn <= (SELECT greatest(0, least(2000 - p, q)) FROM c)""",
    ),
)
def q_capped_sample(spark, sf):
    ev = events_scored(spark, sf).select("event_id", "label")
    return sampling.capped_sample(ev, ["event_id"], cap=2000, seed=0)


@register(
    "replay_sample",
    with_sql(
        EVENTS_SQL,
        body=f"""SELECT event_id, value FROM (
  SELECT event_id, value, row_number() OVER (ORDER BY {_EV_HASH}, event_id) AS rn FROM events_scored) t
WHERE rn <= 500""",
    ),
)
def q_replay_sample(spark, sf):
    ev = events_scored(spark, sf).select("event_id", "value")
    return sampling.replay_sample(ev, 500, ["event_id"], seed=0)


@register("head_n", with_sql(EVENTS_SQL, body="SELECT event_id, value FROM events_scored ORDER BY ts, event_id LIMIT 500"))
def q_head_n(spark, sf):
    return sampling.head_n(events_scored(spark, sf), 500, ["ts", "event_id"]).select("event_id", "value")


@register(
    "class_weight",
    with_sql(
        SCORED_SQL,
        """c AS (SELECT CAST(sum(label) AS BIGINT) AS p, count(*) - CAST(sum(label) AS BIGINT) AS q FROM scored)""",
        body=f"""SELECT {KEYS_SQL}, CASE WHEN label = 1 THEN (SELECT q::DOUBLE / p FROM c) ELSE 1.0::DOUBLE END AS weight
FROM scored""",
    ),
)
def q_class_weight(spark, sf):
    return sampling.class_weight(scored(spark, sf)).select(*KEYS, "weight")


@register(
    "standard_scale",
    with_sql(
        SCORED_SQL, _RN_SQL, _SPLIT2_SQL,
        """p AS (SELECT avg(l_extendedprice) AS ma, stddev_pop(l_extendedprice) AS sa,
                avg(time_us) AS mt, stddev_pop(time_us) AS st FROM split WHERE part = 'train')""",
        body=f"""SELECT {KEYS_SQL}, round((l_extendedprice - ma) / sa, 6) AS amount_scaled,
  round((time_us - mt) / st, 6) AS time_scaled FROM split, p""",
    ),
)
def q_standard_scale(spark, sf):
    s = split2(spark, sf)
    params = features.fit_scaler(s.filter(F.col("part") == "train"), ["l_extendedprice", "time_us"])
    out = features.apply_scaler(s, params, suffix="_z")
    return out.select(
        *KEYS,
        F.round("l_extendedprice_z", 6).alias("amount_scaled"),
        F.round("time_us_z", 6).alias("time_scaled"),
    )


@register(
    "decisions",
    with_sql(SCORED_SQL, body=f"SELECT {KEYS_SQL}, CAST(score >= 0.5 AS INTEGER) AS decision FROM scored"),
)
def q_decisions(spark, sf):
    return features.decisions(scored(spark, sf), 0.5).select(*KEYS, "decision")


@register(
    "validate_contract",
    with_sql(
        """v AS (SELECT event_id,
                CASE WHEN event_id % 13 = 5 THEN NULL WHEN event_id % 13 = 6 THEN 'NaN'::DOUBLE ELSE value END AS value,
                CASE WHEN event_id % 11 = 3 THEN NULL ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k
                FROM events)""",
        body="""SELECT event_id, CASE WHEN isnan(value) THEN -1.0 ELSE value END AS value, k,
  concat_ws(',', CASE WHEN value IS NULL OR isnan(value) THEN 'value' END,
                 CASE WHEN k IS NULL OR isnan(k) THEN 'k' END) AS reasons,
  (value IS NOT NULL AND NOT isnan(value) AND k IS NOT NULL AND NOT isnan(k)) AS is_valid
FROM v""",
    ),
)
def q_validate_contract(spark, sf):
    from costlens.sources import read_table

    # some events break the contract: no value, NaN, text where a number belongs
    value = F.when(F.col("event_id") % 13 == 6, F.lit(float("nan"))).when(F.col("event_id") % 13 != 5, F.col("value"))
    k = F.when(F.col("event_id") % 11 == 3, F.lit("many")).otherwise(F.get_json_object("props", "$.k"))
    ev = read_table(spark, sf, "events").select("event_id", value.alias("value"), k.alias("k"))
    checked = features.validate_contract(ev, ["value", "k"], ["event_id"])
    shown = F.when(F.isnan("value"), F.lit(-1.0)).otherwise(F.col("value")).alias("value")  # NaN has no equal to compare with
    return checked.select("event_id", shown, "k", F.array_join("reasons", ",").alias("reasons"), "is_valid")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "time_us"]


@register(
    "select_features",
    with_sql(
        SCORED_SQL,
        body="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label,
  l_extendedprice AS amount, time_us AS time, l_quantity, l_discount, l_tax FROM scored""",
    ),
)
def q_select_features(spark, sf):
    """B1 + E2: features by name in pipeline order (scaled Amount, Time first)."""
    spec = features.FeatureSpec(features=tuple(FEATURES), scaled=("l_extendedprice", "time_us"))
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label"]
    out = features.select_features(scored(spark, sf), spec, keep=keep).select(*keep, *spec.pipeline_order())
    return out.withColumnRenamed("l_extendedprice", "amount").withColumnRenamed("time_us", "time")


@register("filter_class", with_sql(SCORED_SQL, body=f"SELECT {KEYS_SQL}, score FROM scored WHERE label = 1"))
def q_filter_class(spark, sf):
    """The positive class only (predicate on the derived label)."""
    return features.filter_class(scored(spark, sf), 1).select(*KEYS, "score")


@register(
    "select_by_prefix",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority FROM orders",
)
def q_select_by_prefix(spark, sf):
    """Every column whose name starts with a prefix (the time as microseconds, alike in both engines)."""
    from costlens.functions.columns import epoch_micros
    from costlens.sources import read_table

    o = features.select_by_prefix(read_table(spark, sf, "orders"), "o_")
    return o.withColumn("o_orderdate", epoch_micros(F.col("o_orderdate").cast("timestamp_ntz")))
