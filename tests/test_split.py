from pyspark.sql import functions as F

from costlens.operators import split


def test_train_ends_before_test_begins(spark):
    times = [(i * 37 % 140) * 2.5 for i in range(140)]
    df = spark.createDataFrame([(t, t % 7, int(t) % 2, i) for i, t in enumerate(times)], "Time double, Amount double, Class int, rid long")
    out = split.chronological_split(df, "Time", ["rid"])
    train, test = out.where("part = 'train'"), out.where("part = 'test'")
    assert (train.count(), test.count()) == (112, 28)
    assert train.agg(F.max("Time")).first()[0] < test.agg(F.min("Time")).first()[0]


def test_split_breaks_ties_by_tie_columns(spark):
    rows = [(float(i // 10), i) for i in range(100)]  # 10 rows per Time value
    df = spark.createDataFrame(rows, "Time double, rid long")
    out = split.chronological_split(df, "Time", ["rid"], 0.25)
    ids = sorted(r["rid"] for r in out.where("part = 'train'").collect())
    assert ids == list(range(75))


def test_truncation_of_split_index(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(7)], "Time double, rid long")
    out = split.chronological_split(df, "Time", ["rid"], 0.3)
    assert out.where("part = 'train'").count() == int(7 * (1 - 0.3))


def test_three_way_split(spark):
    df = spark.createDataFrame([(float(i), i, i % 2) for i in range(200)], "Time double, rid long, label int")
    out = split.three_way_split(df, "Time", ["rid"], 0.2, 0.15)
    counts = {r["part"]: r["n_rows"] for r in split.split_summary(out).collect()}
    assert counts == {"fit": 136, "calib": 24, "test": 40}
    mx = {r["part"]: r["m"] for r in out.groupBy("part").agg(F.max("Time").alias("m")).collect()}
    mn = {r["part"]: r["m"] for r in out.groupBy("part").agg(F.min("Time").alias("m")).collect()}
    assert mx["fit"] < mn["calib"] and mx["calib"] < mn["test"]


def _exact(df, order, ties, size):
    rows = split.chronological_split(df, order, ties, size)
    return {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}


def test_a_table_of_copies_splits_exactly(spark):
    copies = spark.createDataFrame([(1.0, "a")] * 900 + [(2.0, "b")] * 100, "Time double, v string").repartition(7)
    assert _exact(copies, "Time", [], 0.2) == {"train": 800, "test": 200}
    out = split.chronological_split(copies, "Time", [], 0.2)
    assert out.columns == ["Time", "v", "part"] and out.where("v = 'b' and part = 'train'").count() == 0
    three = split.three_way_split(copies, "Time", [], 0.2, 0.15)
    assert {r["part"]: r["n_rows"] for r in split.split_summary(three.withColumn("label", F.lit(1))).collect()} == {"fit": 680, "calib": 120, "test": 200}


def test_ties_beyond_the_tie_columns_are_ordered_by_the_row(spark):
    rows = [(float(i // 50), i % 5, f"row {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "Time double, k int, v string")
    one = split.chronological_split(df, "Time", ["k"], 0.33)
    two = split.chronological_split(df.repartition(13), "Time", ["k"], 0.33)
    key = lambda out: sorted((r["v"], r["part"]) for r in out.collect())
    assert key(one) == key(two) and one.where("part = 'train'").count() == int(400 * (1 - 0.33))


def test_any_orderable_type_and_null_times(spark):
    for n in (700, 6000):  # fewer and more distinct values than any bucket count
        df = spark.range(n).select(
            F.col("id"),
            F.timestamp_seconds(F.col("id") * 61).cast("timestamp_ntz").alias("ntz"),
            F.timestamp_seconds(F.col("id") * 61 - 10**5).alias("tz"),
            F.concat(F.lit("shared prefix "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"),
            F.when(F.col("id") % 4 > 0, F.col("id") / 8).alias("nulls"),
            F.date_add(F.lit("1950-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("day"),
            (F.col("id") - 10).cast("decimal(30,2)").alias("money"),
        )
        k = int(n * (1 - 0.2))
        for order in ("ntz", "tz", "text", "money"):
            out = split.chronological_split(df, order, ["id"], 0.2, n_buckets=200)
            assert {r["id"] for r in out.where("part = 'train'").select("id").collect()} == set(range(k)), order
        for order in ("nulls", "day"):
            out = split.chronological_split(df, order, ["text"], 0.2)
            assert out.where("part = 'train'").count() == k
            late = out.where("part = 'test'").agg(F.min(order)).first()[0]
            assert out.where("part = 'train'").agg(F.max(order)).first()[0] <= late
        assert split.chronological_split(df, "nulls", ["id"], 0.2).where("nulls is null and part = 'test'").count() == 0
