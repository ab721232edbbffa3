"""What the operators share: tables, the shared folder, Arrow batches cut by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; on a local master without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tarmac-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark removes an execution's shuffle files at its end when this is set; else only once the driver's collector sees them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, lost executors take nothing along, its exchanges go at once.
    by: columns that it is filed by."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and no later step reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)


def id_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, by its own names, so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about limit text bytes; null texts read as empty."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        filled = pc.fill_null(batch.column(k).cast(pa.large_string()), "")
        batch = batch.set_column(k, column, filled)
        sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(sizes):
            yield batch.slice(start)


def give_back() -> None:
    """Returns what this worker has freed to the machine; its allocator would keep it through later stages."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_fold(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder
