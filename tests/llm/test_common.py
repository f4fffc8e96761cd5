import pytest
from pyspark.sql import functions as F

from lorekeep.llm import common


@pytest.fixture
def merged(spark):
    """Without Spark's own choice to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("hot", [0, 4000])
def test_spread_join_broadcasts_nothing(merged, hot):
    rows = common.written(merged.range(5000).select("id", F.when(F.col("id") < hot, -7).otherwise(F.col("id")).alias("key")))
    out = common.spread_join(rows, rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.agg(F.count("*"), F.sum(F.col("n"))).first() == ((5000, 5000) if not hot else (5000, 4000 * 4000 + 1000))


@pytest.mark.parametrize("kind", ["binary", "string", "int", "array<float>", "double"])
def test_spread_join_of_any_key(spark, kind):
    """A hot key's rows on the left find the other side's row, also minus zero that of zero, and nulls stay in a left join."""
    one = {"binary": "cast('a' as binary)", "string": "'a'", "int": "7", "array<float>": "array(if(id % 4 = 0, -0.0f, 0.0f))", "double": "if(id % 4 = 0, -0.0d, 0.0d)"}[kind]
    rows = common.written(spark.range(4000).selectExpr("id", f"if(id % 2 = 0, {one}, null) as key"))
    others = spark.range(1).withColumn("id", F.lit(1)).selectExpr(f"{one} as key", "'x' as name")
    assert common.spread_join(rows, others, "key").count() == 2000
    left = common.spread_join(rows, others, "key", how="left")
    assert left.count() == 4000 and left.where("name = 'x'").count() == 2000


def test_finished_components_take_few_jobs(spark):
    """Stars are seen to be done by the first minima, with two tables and a look at one."""
    links = common.written(spark.range(1, 100).selectExpr("id as a", "id % 3 - 3 as b"))
    made, own = [], common.written
    common.written = lambda df: made.append(1) or own(df)
    try:
        got = {r.node: r.root for r in common.components(links).collect()}
    finally:
        common.written = own
    assert got == {i: i % 3 - 3 for i in range(1, 100)} | {i: i for i in (-3, -2, -1)}
    assert len(made) == 2
