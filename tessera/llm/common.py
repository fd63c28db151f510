"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import shared_dir, workers_find_package


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession, most: int = 8 << 20) -> None:
    """Batches for Python workers are bounded by so many bytes, unless the session says otherwise: texts may be long, and a
    batch exists several times, in the executor and in its worker."""
    workers_find_package(spark)
    now = spark.conf.get(ARROW_BYTES).rstrip("bB")
    if now == str(64 << 20) or (now == str(8 << 20) and most < 8 << 20):
        spark.conf.set(ARROW_BYTES, str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text, under fixed names: other columns, and their names, can't clash."""
    lean(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


@functools.cache
def one_thread() -> None:
    """A worker's matrix products take one thread each: a task has a core, and threads that wait for each other burn more."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:  # elsewhere than on Linux the library's own setting holds
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


@functools.cache
def _c_library() -> ctypes.CDLL | None:
    try:
        library = ctypes.CDLL("libc.so.6")
        return library if hasattr(library, "malloc_trim") else None
    except OSError:
        return None


@functools.cache
def keep_freed() -> None:
    """Up to 64 MB that a worker frees stay with it until give_back: arrays of some megabytes that are made and freed in a loop
    would come as new pages each time, which cost as much as the work on them when all cores ask for some."""
    if (library := _c_library()) is not None:
        library.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        library.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Freed memory goes back to the system: allocators keep it otherwise, about as much again as a worker needs."""
    pa.default_memory_pool().release_unused()
    if (library := _c_library()) is not None:
        library.malloc_trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with freed memory given back after every few megabytes of input, and at the end: workers outlive their tasks."""

    def pulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            done += batch.nbytes
            yield batch
            if done >= every:
                done = 0
                del batch
                give_back()

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pulled(batches))
        give_back()

    return inner


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow by place: run gets and gives columns in order, whatever they are called."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(thrifty(run), plain).toDF(*schema.names)


SALTS, LEAST_HOT = 64, 200


def hot_keys(table: DataFrame, *keys: str, count: str | None = None) -> list[int]:
    """Hashes of the keys that more than a thousandth of a written table's rows have, and more than a few: at most a thousand.
    count: a column that says how many rows a row stands for."""
    rows = table.agg(F.sum(count) if count else F.count("*")).first()[0] or 0
    n = table.groupBy(*keys).agg((F.sum(count) if count else F.count("*")).alias("_n")).where(F.col("_n") > max(LEAST_HOT, rows / 1000))
    return [r[0] for r in n.select(F.xxhash64(*keys)).distinct().collect()]


def salted_join(big: DataFrame, small: DataFrame, key: str | list[str], hot: list[int], spread_by: list[str | Column], how: str = "inner") -> DataFrame:
    """big joined with small on the key columns; big's rows of the keys in hot are salted, and small's repeated for each salt."""
    keys = [key] if isinstance(key, str) else key
    if not hot:
        return big.join(small, keys, how)
    among = F.xxhash64(*keys).isin(hot)
    left = big.withColumn("_salt", F.when(among, F.pmod(F.xxhash64(*spread_by), F.lit(SALTS))).otherwise(0).cast("int"))
    right = small.withColumn("_salt", F.explode(F.when(among, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole keys from batches that are sorted by them: a worker holds some rows and one key's, not its partition."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(rows, dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = int(np.argmax(last))  # sorted: the last key's rows are together at the end
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
        least = max(least, 2 * rows) if not cut else least
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
