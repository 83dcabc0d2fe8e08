"""Tables that cut lineage, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphweft-"))
    return sc.getCheckpointDir()


def scratch_path(df: DataFrame) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    spark, path = df.sparkSession, f"{_folder(df).rstrip('/')}/graphweft-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return path


def stored(df: DataFrame, by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder with a directory for each value of ``by``, so a scan reads only those it asks for.
    Large values are split over tasks; the table goes when the driver's JVM ends."""
    spark, path = df.sparkSession, scratch_path(df)
    df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` through a reliable checkpoint in ``spark.checkpoint.dir``; a temporary folder stands in on a local master only."""
    _folder(df)
    return df.checkpoint()
