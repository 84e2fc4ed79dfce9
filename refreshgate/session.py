"""Session settings and the places where long lineages are cut."""
import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession


RUN_FOLDER = "run-"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the submitter's own session is used."""
    builder = (SparkSession.builder.master(master).appName("refreshgate")
               .config("spark.sql.shuffle.partitions", shuffle_partitions)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder among those every executor can reach, under `spark.checkpoint.dir`.

    What is written there serves this run only; it is removed when the driver's Python ends in good order.
    """
    return f"{_shared_root(spark)}/{RUN_FOLDER}{spark.sparkContext.applicationId}"


def remove_run_folder(spark: SparkSession) -> None:
    """Delete the application's folder. What still reads from it fails then."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _remove_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has been stopped, and nothing can be reached
        remove_run_folder(spark)


def _shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from `spark.checkpoint.dir`.

    Only a local master may go without the setting: it gets a new temporary folder, since all its tasks share this
    machine. Anywhere else a machine-local folder would be lost with its executor, so it is refused.
    """
    context = spark.sparkContext
    known = getattr(_shared_root, "application", None) == context.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or (_shared_root.given if known else context.getCheckpointDir())
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    if not known:
        _shared_root.application, _shared_root.given = context.applicationId, folder
        atexit.register(_remove_at_exit, spark)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it back.

    The plan stops growing, a lost executor costs nothing already computed, and what follows knows the true size of
    the data, so a small side is broadcast without a shuffle.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """`cut_lineage`, and aggregates over the rows that come with the write itself, without another job."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, *(c.alias(name) for name, c in counts.items())))
    return cut, seen.get


def share_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(share_code, "application", None) == context.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="code-"), "refreshgate-code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    share_code.application = context.applicationId
