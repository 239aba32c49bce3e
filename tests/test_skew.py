"""A key holding a third of all rows: partial aggregation before the shuffle,
null keys kept out of joins, correct results."""

from pyspark.sql import functions as F

from parcelgrid.operators.dedupe import first_wins
from parcelgrid.operators.ledger import insert_if_absent, unvisited_houses


def _skewed(spark, n=30000):
    # every third row has the hot key "hot"; others are unique
    return (spark.range(n, numPartitions=8)
            .select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                    (F.col("id") % 7).alias("file"), F.col("id").alias("pos"),
                    F.concat(F.lit("u"), F.col("id").cast("string")).alias("url")))


def test_first_wins_combines_hot_key_before_shuffle(spark):
    df = _skewed(spark)
    out = first_wins(df, "k", ["file", "pos"], ["url"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    pre_shuffle = plan.split("Exchange hashpartitioning")[1]
    assert "partial_min" in pre_shuffle
    hot = out.filter(F.col("k") == "hot").first()
    assert (hot.file, hot.pos, hot.url) == (0, 0, "u0")
    assert out.count() == 1 + 20000


def test_null_ids_bypass_joins(spark):
    master = spark.range(30000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("zpid"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("detailUrl"))
    ids = spark.range(0, 30000, 2).select(F.col("id").cast("string").alias("zpid"))
    urls = spark.range(0, 30000, 5).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("detailUrl"))
    out = unvisited_houses(master, ids, urls)
    expect = sum(1 for i in range(30000) if (i % 3 == 0 or i % 2 == 1) and i % 5 != 0)
    assert out.count() == expect
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # rows without id are a separate union branch that never meets the id join
    assert plan.startswith("Union") and plan.count("LeftAnti, (zpid") == 1
    statuses = insert_if_absent(master.withColumn("o", F.monotonically_increasing_id()), ids, "zpid", "o")
    assert statuses.filter(F.col("zpid").isNull() & (F.col("status") == "saved")).count() == 10000
