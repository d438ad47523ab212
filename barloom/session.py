"""Session settings and lineage cutting shared by the library, tests and bench."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own session; the library never builds one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a frame that many later jobs read (for example model fits).

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without that setting (tests)
    gets a folder of its own; on a cluster a folder of one machine would lose data, so its absence is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barloom-checkpoint-"))
    return df.checkpoint()
