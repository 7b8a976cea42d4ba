"""The registered collection search reads whole turns, also those that its SQL cuts."""

from pyspark.sql import functions as F

from graphloom.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_text_after_the_cut_is_found(spark, tmp_path):
    spark.read.parquet(f"{DIR}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    said = spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text")
    first = said.agg(F.min("conv_id")).first()[0]
    late = F.concat(F.lit("x" * 100), F.lit(" promo"))
    said.withColumn("text", F.when(F.col("conv_id") == first, late).otherwise(F.lit("none"))).write.parquet(f"{tmp_path}/conversations.parquet")
    before = {r["id"] for r in catalog.QUERIES["collection_search"](spark, DIR).collect()}
    got = {r["id"] for r in catalog.QUERIES["collection_search"](spark, str(tmp_path)).collect()}
    assert first in got and got - before <= {first}
    said.where(F.col("conv_id") == first).limit(1).withColumn("text", late).withColumn("conv_id", F.lit(first)).write.parquet(f"{tmp_path}/one/conversations.parquet")
    spark.createDataFrame([(i, "Brand#1", "T", "n", 1, 1.0) for i in range(3)], "p_partkey bigint, p_brand string, p_type string, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/one/part.parquet")
    assert [r["id"] for r in catalog.QUERIES["collection_search"](spark, f"{tmp_path}/one").collect()] == [first]
