"""Registered queries return all that matches, however much that is."""

from pyspark.sql import functions as F

from quarry.plans import replay  # noqa: F401  registers its queries
from quarry.plans.queries import QUERIES


def test_unmapped_fields_over_more_than_a_page(spark, tmp_path):
    keys = spark.range(1, 6001).select(F.col("id"), F.lit("x").alias("name"), F.lit(1.5).alias("balance"))
    keys.toDF("c_custkey", "c_name", "c_acctbal").withColumn("c_mktsegment", F.lit("BUILDING")).write.parquet(f"{tmp_path}/customer.parquet")
    keys.where("id <= 3").toDF("s_suppkey", "s_name", "s_acctbal").withColumn("s_acctbal", -F.col("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = [tuple(r) for r in QUERIES["multi_index_unmapped"](spark, str(tmp_path)).collect()]
    assert got[:4] == [("customer", 1), ("supplier", 1), ("customer", 2), ("supplier", 2)]
    assert len(got) == 6003 and {k for i, k in got if i == "customer"} == set(range(1, 6001))


def test_scroll_of_many_pages_is_one_scan(spark, tmp_path):
    spark.range(1, 20002).selectExpr("id AS o_orderkey", "id % 10 AS o_custkey", "'F' AS o_orderstatus", "cast(id % 5000 AS double) AS o_totalprice", "'5-LOW' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["scroll_pages"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 2
    by_price = sorted(range(1, 20002), key=lambda k: (-(k % 5000), k))
    assert sorted((r["page"], r["o_orderkey"]) for r in df.collect()) == sorted((n // 4000, k) for n, k in enumerate(by_price))
