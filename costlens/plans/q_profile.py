"""Registered profiling and I/O queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.operators import metrics, profile, runlog
from costlens.plans.registry import register
from costlens.plans.views import SCORED_ID, SCORED_SQL, matrix, scored, with_sql
from costlens.session import scratch_path
from costlens.sources import io, read_table

KEYS = [*SCORED_ID, "label"]
KEYS_SQL = ", ".join(KEYS)


@register(
    "class_balance",
    with_sql(
        SCORED_SQL,
        body="""SELECT n_negative, n_positive, CASE WHEN n_positive = 0 THEN NULL ELSE n_negative::DOUBLE / n_positive END AS imbalance_ratio
FROM (SELECT count(CASE WHEN label = 0 THEN 1 END) AS n_negative, count(CASE WHEN label = 1 THEN 1 END) AS n_positive FROM scored) t""",
    ),
)
def q_class_balance(spark, sf):
    return profile.class_balance(scored(spark, sf))


_MATRIX_LONG_SQL = """ml AS (
  SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, 'f' || CAST(i - 1 AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT label, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings) t)"""


@register(
    "mean_shift_by_class",
    with_sql(
        _MATRIX_LONG_SQL,
        body="""SELECT feature, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(abs(m0 - m1), 6) AS abs_diff
FROM (SELECT feature, avg(CASE WHEN label = 0 THEN value END) AS m0, avg(CASE WHEN label = 1 THEN value END) AS m1
      FROM ml GROUP BY feature) t
ORDER BY abs_diff DESC, feature LIMIT 10""",
    ),
)
def q_mean_shift_by_class(spark, sf):
    long = profile.array_features(matrix(spark, sf), "features", keep=["label"])
    return profile.mean_shift_by_class(long, top=10)


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "score", "label"]
_PAIRS = list(combinations(CORR_COLS, 2))
_CORR_SQL = with_sql(
    SCORED_SQL,
    "c AS (SELECT " + ", ".join(f"corr({a}::DOUBLE, {b}::DOUBLE) AS c{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM scored)",
    body="\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(c{i}, 6) AS corr FROM c" for i, (a, b) in enumerate(_PAIRS)),
)


@register("correlation_matrix", _CORR_SQL)
def q_correlation_matrix(spark, sf):
    return profile.correlation_matrix(scored(spark, sf), CORR_COLS)


@register(
    "box_stats",
    with_sql(
        SCORED_SQL,
        """q AS (SELECT label, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
              quantile_cont(l_extendedprice, 0.75) AS q3 FROM scored GROUP BY label)""",
        body="""SELECT s.label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(CASE WHEN l_extendedprice >= q1 - 1.5::DOUBLE * (q3 - q1) THEN l_extendedprice END) AS whisker_low,
  max(CASE WHEN l_extendedprice <= q3 + 1.5::DOUBLE * (q3 - q1) THEN l_extendedprice END) AS whisker_high,
  count(CASE WHEN l_extendedprice < q1 - 1.5::DOUBLE * (q3 - q1) OR l_extendedprice > q3 + 1.5::DOUBLE * (q3 - q1) THEN 1 END) AS n_outliers
FROM scored s JOIN q ON s.label = q.label GROUP BY s.label, q1, median, q3""",
    ),
)
def q_box_stats(spark, sf):
    return profile.box_stats(scored(spark, sf), "l_extendedprice", by=["label"])


@register(
    "density_histogram",
    with_sql(
        SCORED_SQL,
        """w AS (SELECT lo, (hi - lo) / 48.0::DOUBLE AS width FROM
          (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM scored) r)""",
        """c AS (SELECT label, CAST(least(floor((l_extendedprice - lo) / width), 47) AS INTEGER) AS bin, count(*) AS cnt
          FROM scored, w GROUP BY 1, 2)""",
        """pc AS (SELECT label, sum(cnt) AS nc FROM c GROUP BY label)""",
        """g AS (SELECT label, nc, CAST(b AS INTEGER) AS bin FROM pc, range(48) t(b))""",
        body="""SELECT g.label, g.bin, lo + g.bin * width AS bin_lo, coalesce(c.cnt, 0) AS count,
  coalesce(c.cnt, 0) / (nc * width) AS density
FROM g LEFT JOIN c ON g.label = c.label AND g.bin = c.bin, w""",
    ),
)
def q_density_histogram(spark, sf):
    return profile.density_histogram(scored(spark, sf), "l_extendedprice", 48)


@register(
    "percentile_report",
    """SELECT count(value) AS count, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM events""",
)
def q_percentile_report(spark, sf):
    return profile.percentile_report(read_table(spark, sf, "events"), "value", (50, 95))


@register(
    "clipped_histogram",
    """WITH c AS (SELECT quantile_cont(value, 0.995) AS cap FROM events)
SELECT CAST(least(floor(value * (50.0::DOUBLE / cap)), 49) AS INTEGER) AS bin, count(*) AS n
FROM events, c WHERE value >= 0 AND value <= cap GROUP BY 1""",
)
def q_clipped_histogram(spark, sf):
    return profile.clipped_histogram(read_table(spark, sf, "events"), "value", 50, 99.5)


@register("csv_roundtrip", with_sql(SCORED_SQL, body=f"SELECT {KEYS_SQL}, score FROM scored"))
def q_csv_roundtrip(spark, sf):
    s = scored(spark, sf).select(*KEYS, "score")
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ["l_orderkey"]]
        + [T.StructField("l_linenumber", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ["l_partkey", "l_suppkey"]]
        + [T.StructField("l_extendedprice", T.DoubleType()), T.StructField("time_us", T.LongType()),
           T.StructField("label", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )
    path = io.write_csv(s, scratch_path(spark, "csv"))
    return io.read_transactions_csv(spark, path, schema)


@register(
    "json_roundtrip",
    """SELECT event_id,
  CASE WHEN event_id % 7 IN (1, 2, 3, 4) THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 7 IN (1, 3, 4) THEN NULL ELSE CAST(user_id AS DOUBLE) END AS user_id,
  event_id % 7 IN (1, 2, 4) AS _corrupt
FROM events""",
)
def q_json_roundtrip(spark, sf):
    """Encoded events, of which some are damaged on the way: cut off (1), a field of another type (2), a valid record
    without fields (3), lost (4)."""
    ev = read_table(spark, sf, "events")
    enc = io.encode_events(ev, ["value", "user_id"], key="event_id")
    kind, text = F.col("event_id") % 7, F.col("payload")
    broken = (
        F.when(kind == 1, F.substring(text, 1, 9))
        .when(kind == 2, F.regexp_replace(text, '"value":[^,]*', '"value":"text"'))
        .when(kind == 3, F.lit('{"value":null}'))
        .when(kind == 4, F.lit(None))
        .otherwise(text)
    )
    schema = io.transaction_schema(["value", "user_id"], label=None)
    return io.decode_events(enc.withColumn("payload", broken), schema, keep=["event_id"])


@register(
    "split_parquet_roundtrip",
    with_sql(
        SCORED_SQL,
        """r AS (SELECT *, row_number() OVER (ORDER BY time_us, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
                count(*) OVER () AS n FROM scored)""",
        body=f"SELECT {KEYS_SQL}, score FROM r WHERE rn > CAST(floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT)",
    ),
)
def q_split_parquet_roundtrip(spark, sf):
    from costlens.plans.q_split import split2

    path = io.write_split(split2(spark, sf).select(*KEYS, "score", "part"), scratch_path(spark, "split"))
    return io.load_split(spark, path, "test", [*KEYS, "score"])


@register(
    "run_metrics_long",
    with_sql(
        SCORED_SQL,
        """conf AS (
  SELECT count(CASE WHEN label = 1 AND score >= 0.5 THEN 1 END)::DOUBLE AS true_positives,
         count(CASE WHEN label = 0 AND score < 0.5 THEN 1 END)::DOUBLE AS true_negatives,
         count(CASE WHEN label = 0 AND score >= 0.5 THEN 1 END)::DOUBLE AS false_positives,
         count(CASE WHEN label = 1 AND score < 0.5 THEN 1 END)::DOUBLE AS false_negatives,
         round(avg(power(score - label, 2)), 6) AS brier_score
  FROM scored)""",
        body="""SELECT 'r0' AS run_id, 'evaluation' AS experiment, 'metric' AS kind, key, value, '' AS text
FROM (UNPIVOT conf ON true_positives, true_negatives, false_positives, false_negatives, brier_score INTO NAME key VALUE value) u
UNION ALL SELECT 'r0', 'evaluation', 'param', 'threshold', 0.5, '0.5'
UNION ALL SELECT 'r0', 'evaluation', 'param', 'model', -1.0, 'scored'""",
    ),
)
def q_run_metrics_long(spark, sf):
    """A run's metrics and parameters logged to one dataset and read back (no number: -1, no text: empty)."""
    path = scratch_path(spark, "runs")
    metrics_rows = runlog.metrics_long(_record(scored(spark, sf)), "r0", "evaluation")
    params = runlog.params_long(spark, {"threshold": 0.5, "model": "scored"}, "r0", "evaluation")
    for _ in range(2):  # a retried run is logged once
        runlog.commit_run([metrics_rows, params], path, "r0", "evaluation")
    return runlog.read_runs(spark, path).fillna({"value": -1.0, "text": ""})


def _record(s):
    from costlens.operators.frames import attach_one_row

    return attach_one_row(metrics.confusion(s, 0.5), metrics.brier_score(s))


@register(
    "error_by_class_scores",
    with_sql(
        SCORED_SQL,
        """e AS (SELECT label, power(score - label, 2) AS error FROM scored)""",
        """r AS (SELECT avg(CASE WHEN label = 1 THEN error END) / avg(CASE WHEN label = 0 THEN error END) AS ratio FROM e)""",
        body="""SELECT label, round(avg(error), 6) AS mean_error, count(*) AS n,
  (SELECT round(ratio, 6) FROM r) AS ratio_pos_to_neg FROM e GROUP BY label""",
    ),
)
def q_error_by_class_scores(spark, sf):
    """G7 over a given error column: the squared distance of score and label."""
    from costlens.operators.anomaly import error_by_class

    return error_by_class(scored(spark, sf).withColumn("error", F.pow(F.col("score") - F.col("label"), 2)))


_CONTRIBUTIONS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "mean_abs_contribution",
    with_sql(
        SCORED_SQL,
        "m AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in _CONTRIBUTIONS) + " FROM scored)",
        "c AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, (s.{c} - m.{c}) * (1 + label) AS x FROM scored s, m" for c in _CONTRIBUTIONS)
        + ")",
        body="SELECT feature, round(avg(abs(x)), 6) AS mean_abs FROM c GROUP BY feature",
    ),
)
def q_mean_abs_contribution(spark, sf):
    """G11 over given contributions: deviations from the mean, doubled for positives."""
    s = scored(spark, sf)
    means = s.agg(*[F.avg(c).alias(c) for c in _CONTRIBUTIONS]).first()
    wide = s.select(*[((F.col(c) - F.lit(means[c])) * (1 + F.col("label"))).alias(c) for c in _CONTRIBUTIONS])
    return profile.mean_abs_by_feature(profile.long_features(wide, _CONTRIBUTIONS), "value", top=None)


@register(
    "assemble",
    with_sql(
        SCORED_SQL,
        body="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i AS place,
  CASE i WHEN 0 THEN l_extendedprice WHEN 1 THEN time_us::DOUBLE WHEN 2 THEN l_quantity WHEN 3 THEN l_discount ELSE l_tax END AS value
FROM scored, range(5) r(i)""",
    ),
)
def q_assemble(spark, sf):
    """The learners' matrix column in pipeline order, taken apart again place by place."""
    from pyspark.ml.functions import vector_to_array

    from costlens.operators import features

    spec = features.FeatureSpec(features=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "time_us"), scaled=("l_extendedprice", "time_us"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = features.assemble(scored(spark, sf), spec.pipeline_order()).select(*keys, vector_to_array("features").alias("v"))
    return rows.select(*keys, F.posexplode("v").alias("place", "value")).withColumn("place", F.col("place").cast("long"))
