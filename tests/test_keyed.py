import random

from pyspark.sql import Window, functions as F

from crawlspark.operators import keyed as K


def rows(spark, n=400, hot=0.4, seed=7):
    """One key owns two fifths of the rows; some keys are NULL."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else rnd.choice(["a", "b", "c", None])
        data.append((key, i, rnd.choice([None, 1, 2, 3]), rnd.choice(["x", "y", None])))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "k string, i long, v long, s string").repartition(5)


def same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_running_totals_over_many_chunks(spark):
    df = rows(spark)
    whole = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("t", F.coalesce(F.sum("v").over(whole), F.lit(0))).withColumn("n", F.count("*").over(whole))
    for width in (1, 7, 100, 10_000):
        got = K.running_totals(df, ["k"], [F.col("i")], K.span(F.col("i"), width), {"t": F.col("v"), "n": F.lit(1)})
        same(got.select("k", "i", "t", "n"), want)


def test_number_rows(spark):
    df = rows(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("i")).cast("long"))
    same(K.number_rows(df, ["k"], [F.col("i")], K.span(F.col("i"), 13), "n").select("k", "i", "n"), want)


def test_previous_rows_over_many_chunks(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("i")
    want = df.withColumn("p", F.lag("s").over(w)).withColumn("first", F.row_number().over(w) == 1)
    for width in (1, 9, 10_000):
        got = K.previous_rows(df, ["k"], [F.col("i")], K.span(F.col("i"), width), {"p": "s"}, "first")
        same(got.select("k", "i", "p", "first"), want)


def test_top_k_keeps_order_and_limits_before_the_shuffle(spark):
    df = rows(spark)
    got = K.top_k_per_key(df, ["k"], [F.col("v").desc_nulls_last(), F.col("i")], 3, "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last(), "i"))).where("r <= 3")
    same(got, want)
    # A new frame, so the plan has not run and shows each operator once.
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_result_does_not_depend_on_partitioning(spark):
    df = rows(spark)
    one = K.first_per_key(df.coalesce(1), ["s"], [F.col("i")])
    many = K.first_per_key(df.repartition(9), ["s"], [F.col("i")])
    same(one, many)
