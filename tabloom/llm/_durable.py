"""Cutting lineage so that the loss of an executor costs no more than the work since the last cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a session in one process without that setting gets a temporary folder; elsewhere its absence is an error, as a
    folder of one machine would be lost with it.
    """
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder:
        return folder
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tabloom-")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared file system; one that is not there is fine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    The files last as long as the session needs them: ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark
    remove them with the frame, ``discarded`` does so at once.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def discarded(df: DataFrame) -> None:
    """Delete the files of a ``checkpointed`` frame that nothing will read again."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        removed(df.sparkSession, file.get())
