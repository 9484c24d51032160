"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lectern", cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. On a cluster the submitter sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        # One small file would leave all text work to one task; see ``plans.registry.table``.
        .config("lectern.input.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Without that setting a local session gets a fresh temporary folder, made once;
    on a cluster it is an error, as executors do not see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lectern.local.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("lectern.local.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Rows and bytes that a batch for Python holds at most; a task holds several copies of one.
ROWS_AT_ONCE = 1000
BYTES_AT_ONCE = 4 << 20


def modest(df: DataFrame) -> DataFrame:
    """The same table; its session passes rows to Python in batches of bounded size.

    Ten thousand texts, the usual number, are most of a task's memory. Results do not depend on it.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ROWS_AT_ONCE), ("maxBytesPerBatch", BYTES_AT_ONCE)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub(r"\D", "", conf.get(name)) or 0) <= most:
            conf.set(name, str(most))
    return df


def kept(df: DataFrame, label: str) -> DataFrame:
    """The result as a table in the shared folder, for plans that read it more than once.

    Its size is then known, so the planner broadcasts it only when it is small.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table that ``kept`` wrote and returned, when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if not re.search(r"-[0-9a-f]{32}$", folder):
            raise ValueError(f"not a kept table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
