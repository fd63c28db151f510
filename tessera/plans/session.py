"""What a session needs so that Python workers find this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def workers_find_package(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path, where it isn't installed; other entries stay."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder only where it is unset on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Bytes a core, under which a table of few files is dealt anew for work that costs far more than moving it.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table that has fewer files than there are cores, dealt over the cores; other tables as they are."""
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    conf = spark._jsc.hadoopConfiguration()
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if size <= SMALL * cores else df
