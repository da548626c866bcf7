"""Shared folders, worker-side text batches and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six.
WHITE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir.

    Where that is unset, local mode (tests, where the driver is the only executor) gets a folder of its own; a cluster gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colonnade-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Inside, Spark drops an execution's shuffle files when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffle_cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df_or_path, spark: SparkSession | None = None) -> None:
    """Deletes a table that materialise wrote, or a path."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        paths = {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    for p in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def arrow_blocks(batches: Iterator[pa.RecordBatch], max_bytes: int = 4_000_000, text_at: int = -1) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with at most max_bytes of text each; a longer text is a block of its own."""
    for batch in batches:
        start = n = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text_at % batch.num_columns)), 0).to_pylist()):
            if i > start and n + size > max_bytes:
                yield batch.slice(start, i - start)
                start, n = i, 0
            n += size
        if batch.num_rows > start:
            yield batch.slice(start)


def rows_in_blocks(batches: Iterator[pa.RecordBatch], max_bytes: int = 400_000, text_at: int = -1) -> Iterator[tuple[list[list], list[str]]]:
    """The same blocks as Python lists: the other columns, and the texts with null as ''."""
    for block in arrow_blocks(batches, max_bytes, text_at):
        at = text_at % block.num_columns
        yield [c.to_pylist() for i, c in enumerate(block.columns) if i != at], [t or "" for t in block.column(at).to_pylist()]


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ..., and the new name of each: what the columns were called can clash with nothing."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, taken by place: other columns play no part, nor do names that differ in case alone or hold a dot."""
    plain, at = by_place(df)
    folded = {c.lower(): p for c, p in at.items()}
    return plain.select(*(F.col(at.get(n) or folded[n.lower()]).alias(n) for n in names))


def words_column(text) -> F.Column:
    """The words of a text column as an array; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE)), " "), "")
