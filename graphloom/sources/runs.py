"""Versioned writes of an analysis: every table of a run in its own folder, published by one pointer row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(tables: dict[str, DataFrame], root: str, repository_id: str, run_id: int, revision: str) -> None:
    """Write the tables of a run, then its pointer: readers see the old run or the whole new one."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/repository_id={repository_id}/run_id={run_id}")
    broken = tables["diagnostics"].take(1) if "diagnostics" in tables else []
    row = spark.createDataFrame([(run_id, repository_id, revision, "partial" if broken else "completed")], "id bigint, repository_id string, revision string, status string")
    row.withColumn("completed_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/analysis_runs")


def current(spark: SparkSession, root: str, repository_id: str, name: str) -> DataFrame:
    """A table of the repository's newest published run."""
    runs = spark.read.parquet(f"{root}/analysis_runs").where(F.col("repository_id") == repository_id)
    run = runs.agg(F.max("id")).first()[0]
    if run is None:
        raise ValueError(f"no run of {repository_id}")
    return spark.read.parquet(f"{root}/{name}/repository_id={repository_id}/run_id={run}")
