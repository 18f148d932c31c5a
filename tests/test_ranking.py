import random

from pyspark.sql import functions as F

from corpusloom.operators.ranking import first_by_key, first_n, ordered_rank


def skewed(spark, n=4000):
    """Two thirds of the rows in one group."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.67 else f"g{rng.randint(0, 30)}", rng.randint(0, 50), i, f"v{i}") for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, a int, i int, v string").repartition(8)


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row[3])
    return out


def test_first_n(spark):
    rows, df = skewed(spark)
    got = {}
    for r in first_n(df, ["g"], ["a", "i"], 7).collect():
        got.setdefault(r.g, {})[r.rank] = r.v
    assert got == {g: {i + 1: v for i, v in enumerate(vs[:7])} for g, vs in groups(rows).items()}


def test_first_n_beyond_what_a_task_ranks(spark):
    rows, df = skewed(spark)
    for n in (12_000, 2**31 - 1):
        got = {}
        for r in first_n(df.withColumn("g", F.nullif("g", F.lit("g3"))), ["g"], ["a", "i"], n).collect():
            got.setdefault(r.g or "g3", {})[r.rank] = r.v
        assert got == {g: {i + 1: v for i, v in enumerate(vs)} for g, vs in groups(rows).items()}


def test_first_n_prunes_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = first_n(df, ["g"], ["a", "i"], 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number(), 7, Partial") == 2


def test_ordered_rank(spark):
    rows, df = skewed(spark)
    ranked = ordered_rank(df, ["g"], [F.col("a"), F.col("i")])
    got = {}
    for r in ranked.collect():
        got.setdefault(r.g, {})[r.rank] = r.v
    assert got == {g: {i + 1: v for i, v in enumerate(vs)} for g, vs in groups(rows).items()}


def test_ordered_rank_splits_a_single_group(spark):
    df = spark.range(20000).select(F.lit("only").alias("g"), F.col("id").alias("i"), F.xxhash64("id").alias("k"))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        ranked = ordered_rank(df, ["g"], [F.col("k")]).cache()
    finally:
        spark.conf.set(conf, "true")
    keys = [r.k for r in ranked.orderBy("rank").collect()]
    assert keys == sorted(keys) and ranked.agg(F.max("rank")).first()[0] == 20000


def test_first_by_key(spark):
    rows, df = skewed(spark)
    got = {r.g: r.v for r in first_by_key(df, ["g"], ["a", "i"]).collect()}
    assert got == {g: vs[0] for g, vs in groups(rows).items()}
    least = first_by_key(df.select("g", "i"), ["g"], ["i"])
    assert {r.g: r.i for r in least.collect()} == {g: min(r[2] for r in rows if r[0] == g) for g in groups(rows)}
