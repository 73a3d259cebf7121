"""Session settings the jobs are planned for, and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins keyed (bc, salt) must be partitioned by both: see operators.skew
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    # the EM rounds are structurally equal: let their stages share one generated class
    "spark.sql.codegen.useIdInClassName": "false",
    "spark.sql.maxPlanStringLength": "200000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings (all of them may be changed on a live session)."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def limit_batches(spark: SparkSession, size: int) -> None:
    """Arrow batches of the session hold at most ``size`` bytes, unless it has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


def local_session(app: str = "barcloud", cores: str = "8", shuffle: str | None = None) -> SparkSession:
    """Session for tests and the local benchmark; on a cluster the submitter provides one."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle or cores)
        .config("spark.driver.memory", os.environ.get("BARCLOUD_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # static setting, for spark-submit too: the default of 100 generated classes is less than
        # one long window chain has, and every task would compile all of them again
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A temporary folder stands in only on a local master, where all tasks run on one machine; a
    cluster without the setting is an error, for its executors could not read each other's files.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="barcloud-ckpt-")
        sc.setCheckpointDir(configured)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in :func:`shared_folder` and read back: a lineage cut of compressed columns."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_tables(df: DataFrame, name: str, spent: set[str], held: set[str]) -> DataFrame:
    """:func:`write_table` that leaves nothing else behind: shuffle files of the job go with it, and the tables of
    ``spent`` that ``df`` read, unless ``held``, once the new one is whole.  The new table joins ``spent``."""
    spark = df.sparkSession
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        table = write_table(df, name)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    read = {file.rsplit("/", 2)[-2] for file in df.inputFiles()} if spent - held else set()
    for path in [p for p in spent - held if p.rsplit("/", 1)[-1] in read]:
        spent.remove(path)
        _written.remove(path)
        _delete(spark, path)
    spent.add(_written[-1])
    return table


_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_tables(spark: SparkSession) -> None:
    """Deletes what :func:`write_table` wrote in this driver, once no result is read from it any more."""
    while _written:
        _delete(spark, _written.pop())
