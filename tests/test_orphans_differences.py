import datetime as dt

from pyspark.sql import functions as F

from tessera.operators.differences import differences
from tessera.operators.orphans import orphans

D = lambda n: dt.datetime(2024, 1, n)
REF = "id long, k string, n int, at timestamp_ntz, extra string"
PAR = "k string, n int, at timestamp_ntz, gone timestamp_ntz, extra string"
KEYS = [("k", "k"), ("n", "n")]


def found(spark, refs, parents):
    r, p = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)
    return {x.row_id: x.reason for x in orphans(r, p, KEYS, "id", "at", "at", "gone").collect()}


def test_reasons(spark):
    refs = [(1, "a", 1, D(5), "x"), (2, "a", 2, D(5), "x"), (3, "b", 1, D(5), "x"), (4, "c", 1, D(5), "x"), (5, None, 1, D(5), "x"), (6, "a", None, D(5), "x"), (7, "A", 1, D(5), None)]
    parents = [("a", 1, D(1), None, "y"), ("b", 1, D(1), D(9), "y"), ("b", 1, D(2), D(2), "y"), ("c", 1, D(9), None, "y"), ("c", 1, D(1), D(3), "y"), (None, 1, D(1), None, "y")]
    assert found(spark, refs, parents) == {2: "missing", 3: "deleted", 4: "late", 7: "missing"}


def test_first_live_parent_counts(spark):
    assert found(spark, [(1, "a", 1, D(5), "")], [("a", 1, D(9), None, ""), ("a", 1, D(4), None, "")]) == {}
    assert found(spark, [(1, "a", 1, D(5), "")], [("a", 1, D(5), None, "")]) == {}
    assert found(spark, [(1, "a", 1, None, "")], [("a", 1, D(9), None, "")]) == {}
    assert found(spark, [(1, "a", 1, D(5), "")], [("a", 1, None, None, ""), ("a", 1, D(9), None, "")]) == {}


def test_empty_tables_and_repeated_rows(spark):
    assert found(spark, [], [("a", 1, D(1), None, "")]) == {}
    assert found(spark, [(1, "a", 1, D(5), "")], []) == {1: "missing"}
    r = spark.createDataFrame([(1, "a", 1, D(5), "")] * 3, REF)
    assert orphans(r, spark.createDataFrame([], PAR), KEYS, "id", "at", "at", "gone").count() == 3


def test_a_hot_reference_key_is_split(spark):
    """Half of all references name one key: adaptive execution splits its partition."""
    was = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "100k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50k")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    try:
        refs = spark.range(0, 400_000, 1, 4).select("id", F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5000).cast("int").alias("n"), F.lit(D(5)).alias("at"))
        refs = refs.withColumn("at", F.col("at").cast("timestamp_ntz"))
        parents = spark.createDataFrame([("k", i, D(1 + 8 * (i % 2)), None, "") for i in range(4000)], PAR)
        df = orphans(refs, parents, KEYS, "id", "at", "at", "gone")
        n = {r.reason: r["count"] for r in df.groupBy("reason").count().collect()}
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        ids = range(1, 400_000, 2)
        assert n == {"late": sum(i % 5000 < 4000 and i % 5000 % 2 == 1 for i in ids), "missing": sum(i % 5000 >= 4000 for i in ids)}
    finally:
        for c, v in was.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


SIDE = "k string, n int, t string, p int, bucket int, side string"


def diff(spark, a, b, **kw):
    l, r = (spark.createDataFrame(x, SIDE) for x in (a, b))
    return sorted(map(tuple, differences(l, r, ["k", "n"], ["t", "p"], ("left", "right"), **kw).collect()), key=repr)


def test_differences_field_by_field(spark):
    a = [("x", 1, "same", 1, 0, ""), ("x", 2, "old", 1, 0, ""), ("x", 3, "both", 1, 0, ""), ("x", 4, None, None, 0, ""), ("x", 5, "l", 1, 0, ""), (None, 1, "n", 1, 0, "")]
    b = [("x", 1, "same", 1, 9, "z"), ("x", 2, "new", 1, 9, "z"), ("x", 3, "both!", 2, 9, "z"), ("x", 4, "", None, 9, "z"), ("x", 6, "r", 1, 9, "z"), (None, 1, "n", None, 9, "z")]
    want = [(None, 1, "p"), ("x", 2, "t"), ("x", 3, "p"), ("x", 3, "t"), ("x", 4, "t"), ("x", 5, "only_in_left"), ("x", 6, "only_in_right")]
    for n in (1, 2, 4096):
        assert diff(spark, a, b, buckets=n) == sorted(want, key=repr)


def test_many_unequal_buckets_are_joined_and_few_differences_leave_texts_unread(spark):
    a = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"), F.lit("t" * 200).alias("t"), F.lit(1).alias("p"))
    b = a.withColumn("t", F.when(F.col("k") % 100 == 7, "other").otherwise(F.col("t")))
    for most in (0, 10**6):
        df = differences(a, b, ["k", "n"], ["t", "p"], ("l", "r"), most=most)
        assert sorted(r.k for r in df.collect()) == sorted(str(i) for i in range(7, 20_000, 100))
        assert ("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()) == (most > 0)
    # one differing key in a hundred: most rows lie in equal buckets
    buckets = max(4096, 20_000 // 8)
    hit = {int(r.b) for r in b.where("t = 'other'").select(F.pmod(F.xxhash64("k", "n"), F.lit(buckets)).alias("b")).collect()}
    read = b.where(F.pmod(F.xxhash64("k", "n"), F.lit(buckets)).isin(list(hit))).count()
    assert read <= 0.1 * 20_000


def test_differences_repeated_deliveries_and_empty(spark):
    a = [("x", 1, "v" * 50_000, 1, 0, "")]
    assert diff(spark, a * 3, a) == []
    assert diff(spark, [], a) == [("x", 1, "only_in_right")]
    assert diff(spark, [], []) == []


def test_unequal_buckets_alone_are_read_again(spark):
    a = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"), F.lit("t").alias("t"), F.lit(1).alias("p"))
    b = a.withColumn("t", F.when(F.col("k") == "7", "other").otherwise(F.col("t")))
    assert sorted(map(tuple, differences(a, b, ["k", "n"], ["t", "p"], ("l", "r")).collect())) == [("7", 1, "t")]
