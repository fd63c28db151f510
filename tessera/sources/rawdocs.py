"""Raw documents as files: <root>/<version>/docs/<path>, read and listed by Spark's readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version string, path string, content string"


def read(spark: SparkSession, root: str) -> DataFrame:
    """version, path, content of all files; an absent root has none."""
    try:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    inner = F.substring_index("file", root.rstrip("/").split("://")[-1] + "/", -1)
    return files.select(F.regexp_extract(inner, "^(.*?)/docs/", 1).alias("version"), F.url_decode(F.regexp_replace(F.regexp_extract(inner, "^.*?/docs/(.*)$", 1), r"\+", "%2B")).alias("path"), "content")


def write(df: DataFrame, root: str) -> None:
    """Documents as a Parquet table by version; only the versions in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(root)


def read_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("path string, content string, version string").parquet(root)


def write_files(df: DataFrame, root: str) -> int:
    """Each document as a file under the root, through the session's file system; returns their number. For small sets."""
    spark, n = df.sparkSession, 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in df.select("version", "path", "content").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{r.version}/docs/{r.path}")
        stream = path.getFileSystem(conf).create(path, True)
        stream.write((r.content or "").encode())
        stream.close()
        n += 1
    return n


def list_paths(raw: DataFrame, version: str) -> DataFrame:
    return raw.where(F.col("version") == version).select("path").orderBy("path")


def exists(raw: DataFrame, version: str) -> bool:
    return not raw.where(F.col("version") == version).isEmpty()


def versions(raw: DataFrame) -> DataFrame:
    return raw.select("version").distinct().orderBy("version")
