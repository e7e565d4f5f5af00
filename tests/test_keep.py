from pyspark.sql import functions as F

from rillwater.plans import keep


def join_of(big, small):
    joined = big.join(small, "k", "left")
    joined.collect()
    return joined._jdf.queryExecution().executedPlan().toString()


def test_small_sides_are_broadcast_after_a_check(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"))
    small = spark.range(7).select(F.col("id").alias("k"), F.lit("text").alias("t"))
    assert "BroadcastHashJoin" in join_of(big, keep.settle(small))


def test_large_sides_are_not(spark, monkeypatch):
    monkeypatch.setattr(keep, "BROADCAST_BYTES", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "100")
    try:
        big = spark.range(1000).select((F.col("id") % 7).alias("k"))
        small = spark.range(700).select(F.col("id").alias("k"), F.lit("text").alias("t"))
        assert "SortMergeJoin" in join_of(big, keep.settle(small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_released_tables_leave_the_cache(spark):
    small = spark.range(3)
    keep.cached(small).count()
    assert small.is_cached
    keep.release()
    assert not small.is_cached


def test_stored_tables_have_no_lineage(spark):
    stored = keep.store(spark.range(10).select((F.col("id") % 2).alias("k"), "id"), "t", by="k")
    assert stored.columns == ["k", "id"] and stored.count() == 10
    plan = stored.where("k = 1")._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "PartitionFilters" in plan
