"""The tracker as a catalog table or as snapshots in a folder."""
from pyspark.sql import DataFrame, SparkSession

from refreshgate.schemas import TRACKER_COLUMNS


def create_tracker(spark: SparkSession, table: str, using: str = "parquet") -> DataFrame:
    """Create the tracker if it does not exist, with commented columns, and list its columns."""
    columns = ", ".join(f"{name} {kind} COMMENT '{comment}'" for name, (kind, comment) in TRACKER_COLUMNS.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:tracker) ({columns}) USING {using} "
              "COMMENT 'One row per job or pipeline and source group'", args={"tracker": table})
    return spark.sql("DESCRIBE TABLE IDENTIFIER(:tracker)", args={"tracker": table})


def read_tracker(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql("SELECT * FROM IDENTIFIER(:tracker)", args={"tracker": table})


def write_snapshot(tracker: DataFrame, path: str) -> None:
    """Write a new snapshot. An existing path is refused: the snapshot being read must not be overwritten."""
    tracker.select(*TRACKER_COLUMNS).write.mode("errorifexists").parquet(path)
