"""Tables kept in slots by a hash of their key, of which a writer replaces only the slots that it touches."""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refreshgate import schemas


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The n of all `name=n` folders under `path`, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [status.getPath().getName().removeprefix(f"{name}=") for status in files.listStatus(root)]
    return sorted(int(n) for n in found if n.removeprefix("-").isdigit())


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class SlotStore:
    """A table in slots by a hash of `key`: `slot=s/version=v` holds all rows of a slot as they were after tick v."""
    path: str
    schema: str
    key: str
    n_slots: int

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_slots)).cast("int")

    def slots_of(self, rows: DataFrame) -> list[int]:
        """The slots of the keys in `rows`: at most n_slots numbers."""
        return sorted(r[0] for r in rows.select(self.slot()).distinct().collect())

    def read(self, spark: SparkSession, slots: list[int], before: int) -> DataFrame:
        """All rows of `slots` as they were before tick number `before`."""
        paths = []
        for slot in slots:
            versions = [v for v in numbers(spark, f"{self.path}/slot={slot}", "version") if v < before]
            paths += [f"{self.path}/slot={slot}/version={v}" for v in versions[-1:]]
        return spark.read.schema(self.schema).parquet(*paths) if paths else schemas.empty(spark, self.schema)

    def write(self, rows: DataFrame, version: int) -> None:
        """Replace the slots that `rows` fill, given whole. The version before stays for a repeated tick."""
        spark = rows.sparkSession
        (rows.withColumns({"slot": self.slot(), "version": F.lit(version)}).repartition("slot")
         .write.partitionBy("slot", "version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path))

    def trim(self, spark: SparkSession, slots: list[int], version: int) -> None:
        for slot in slots:
            for old in [v for v in numbers(spark, f"{self.path}/slot={slot}", "version") if v <= version][:-2]:
                delete(spark, f"{self.path}/slot={slot}/version={old}")
