"""Keeping the results of a run."""
from pyspark.sql import DataFrame


def write_results(results: DataFrame, folder: str, kind: str, run_id: str) -> str:
    """Write the plan, gate or any other result of one run as Parquet to a folder of its own, and return it.

    The same run and kind a second time is an error, so that a result that others may have read is never replaced.
    """
    path = f"{folder.rstrip('/')}/{kind}/run_id={run_id}"
    results.write.mode("errorifexists").parquet(path)
    return path


def read_results(spark, folder: str, kind: str) -> DataFrame:
    """The results of all runs of one kind, with their run_id."""
    return spark.read.option("mergeSchema", "true").parquet(f"{folder.rstrip('/')}/{kind}")
