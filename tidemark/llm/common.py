"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once; bounds its memory on very long rows. Twice as much where a block
#: has a cost of its own (tables to add up, caches, index shards).
CHARS_AT_ONCE = 250_000
LARGE_BLOCK = 2 * CHARS_AT_ONCE


#: Bytes of one Arrow batch: a Python worker and its JVM hold several copies of one, and texts may be very long. The JVM's
#: lie outside its heap.
BATCH_BYTES = 2 * LARGE_BLOCK


def bounded_batches(spark: SparkSession) -> None:
    """Has the session send Python workers batches of BATCH_BYTES at most; rows of numbers fill none of that size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != str(BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names; other columns stay out of its way."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: the split into learning and held-out rows (a null id gives null)."""
    return F.crc32(F.col(column).cast("string")) % parts


#: What operators keep in a Python worker from task to task: vocabularies and caches, by operator.
_WORKER: dict[str, tuple] = {}


def worker_state(operator: str, key, build):
    """build(), made once in a worker for a key; one key an operator."""
    if operator not in _WORKER or _WORKER[operator][0] != key:
        _WORKER.pop(operator, None)
        _WORKER[operator] = key, build()
    return _WORKER[operator][1]


def release(keep: str | None) -> None:
    """Drops what other operators keep in this worker: workers serve one stage after the other, so what each leaves
    would add up."""
    for name in [name for name in _WORKER if name != keep]:
        del _WORKER[name]


def trim() -> None:
    """Gives what this Python process has freed back to the machine."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_blocks(batches, column: str, limit: int = CHARS_AT_ONCE, operator: str | None = None):
    """Cuts Arrow batches into slices of about `limit` bytes of `column`; yields (slice, its texts). Only the worker
    state of `operator` is kept."""
    import numpy as np
    import pyarrow.compute as pc

    release(operator)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = min(int(np.searchsorted(size, before + limit)) + 1, batch.num_rows)
            yield batch.slice(start, end - start), texts.slice(start, end - start).to_pylist()
            start, before = end, int(size[end - 1])
    trim()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, the context's own or, if
    all executors run in this machine (tests), a new one; on a cluster a local folder would lose rows, so it is refused."""
    import tempfile

    bounded_batches(spark)
    sc = spark.sparkContext
    if not (folder := sc.getConf().get("spark.checkpoint.dir", "")):
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder


#: Bytes of a row group of what is stored: a task holds one while it writes and, of rows with long values, while it reads.
ROW_GROUP = 16 << 20

#: Folders that the innermost `scratch` block of this thread or context is to drop.
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What operators store within the block goes at its end; so results must be stored by then, with outlives."""
    outer = _SCRATCH.set(paths := [])
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        for path in paths:
            _drop(spark, path)
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and checkpoints of tables that nothing refers to any more. It learns of them
    only when the driver collects its garbage, which a long iteration of small jobs may not cause for an hour. What the
    driver's Python has freed goes back to the machine."""
    trim()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Written as Parquet in the shared folder and read again: cut lineage, with columns read as needed. The folder
    goes at the end of a `scratch` block, or, without one or if it outlives it, when the driver's Python ends."""
    import atexit
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    if (paths := _SCRATCH.get()) is not None and not outlives:
        paths.append(path)
    else:
        atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: log2 of the bits in which ids are marked before rows are shuffled to them.
MARK_BITS = 24


def split_by_ids(df: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `ids`, rows whose key is not): only the first need a shuffle to the ids.

    The ids are hashed into a bitmap of fixed size, whatever their number; hits of other ids only cost work."""
    import numpy as np
    import pyarrow as pa

    slots = 1 << (MARK_BITS - 6)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS))
    marked = ids.select(place(F.col("id").cast("long")).alias("at"))
    words = marked.select(F.shiftright("at", 6).alias("slot"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(slots, np.int64)
    found = words.toArrow()  # at most `slots` rows, by one job
    bits[found["slot"].to_numpy()] = found["bits"].to_numpy()
    shipped = df.sparkSession.sparkContext.broadcast(bits)
    name = "__tidemark_at"
    with_place = df.withColumn(name, F.coalesce(place(key.cast("long")), F.lit(0)))

    def rows(wanted: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy()
                keep = np.flatnonzero(((shipped.value[at >> 6] >> (at & 63)) & 1) == wanted)
                if len(keep):
                    part = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
                    yield part.take(pa.array(keep))

        return with_place.mapInArrow(run, df.schema)

    return rows(1), rows(0)


#: A key with more than one in so many rows is hot; there are at most so many of them, whatever the table's size.
HOT_SHARE = 1000


def hot_keys(counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The keys of more than one in HOT_SHARE of all rows, from the count of each key: at most HOT_SHARE rows."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    return counted.where(F.col(n) * HOT_SHARE > total).select(*keys)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how), how being inner or left, for a `right` of one row a key: rows of hot keys stay where
    they are and meet a broadcast of at most HOT_SHARE rows; only the others are shuffled. `left` is read twice."""
    marked = left.join(F.broadcast(hot.withColumn("__tidemark_hot", F.lit(True))), keys, "left")
    some = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    cold = marked.where("__tidemark_hot is null").drop("__tidemark_hot").join(right, keys, how)
    return cold.unionByName(marked.where("__tidemark_hot").drop("__tidemark_hot").join(some, keys, how))
