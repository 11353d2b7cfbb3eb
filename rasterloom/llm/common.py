"""What the training-data operators share: the shared folder, tables cut from their lineage, Arrow plumbing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that part words, as a character class of Java, RE2 and Python.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
BATCH_ROWS = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines see. Where that is unset: a temporary folder of a single machine, on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        where = _own_dir()
    return where.rstrip("/")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="rasterloom-")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterloom/{tag}-{uuid.uuid4().hex}"
    # no plan reads the shuffle files of this write again, so they go when it ends
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._rasterloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_rasterloom_path", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def n_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS))).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def map_batches(df: DataFrame, make: Callable[..., Callable[[pa.RecordBatch], Iterator[dict] | dict]], schema: str, *args) -> DataFrame:
    """mapInArrow where make(*args) is called once a task and gives a function from a batch to columns, or None; at the end its close() is called, if it has one."""

    out = arrow_schema(schema)

    def run(batches):
        f = make(*args)
        for batch in batches:
            for cols in f(batch) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, x.type) for c, x in zip(cols, out, strict=True)], schema=out)
        getattr(f, "close", lambda: None)()
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches have BATCH_ROWS rows at most: they hold whole texts, on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Returns freed memory to the system: the worker lives on beside later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about limit bytes together: bounds what one step holds. A longer text is alone."""
    col = batch.column(batch.schema.get_field_index(text))
    off = offsets(col)
    start = 0
    for i in range(batch.num_rows):
        if off[i + 1] - off[start] > limit and i > start:
            yield batch.slice(start, i - start)
            start = i
    yield batch.slice(start)


def offsets(col: pa.Array):
    """Offsets of a string or binary column into its data buffer."""
    import numpy as np

    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    buf = col.buffers()[1]
    if buf is None or len(col) == 0:
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buf, kind, len(col) + 1, col.offset * kind().itemsize).astype(np.int64)


def utf8(col: pa.Array):
    """Bytes of all texts of a column one after another, and each text's offset. Null is empty."""
    import numpy as np

    off = offsets(col)
    buf = col.buffers()[2]
    if buf is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        return utf8(pa.concat_arrays([col]))
    return np.frombuffer(buf, np.uint8)[off[0] : off[-1]], off - off[0]
