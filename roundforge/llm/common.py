"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of ids that may be broadcast to drop documents (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Text that a Python worker turns into objects at a time.
SLICE_BYTES = 1_000_000
#: Limits of an Arrow batch between the JVM and Python. Spark's default of 10,000 rows is no bound for texts, and its buffers stay allocated.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}
#: The column of row numbers.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="roundforge-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def few_files(spark: SparkSession) -> None:
    """Shuffles of small tables end in as few partitions as their size asks for, unless the session says otherwise: each is a file of a
    table or checkpoint, and where Hadoop lacks its native library, a process that sets the file's permissions."""
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, "false")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_dir(df.sparkSession)
    few_files(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables that scratch() made and that are still there: path, and what deletes it.
_TABLES: dict[str, Callable[[], None]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends, or by drop_tables()."""
    at = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        _TABLES.pop(at, None)
        try:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM may have gone first
            return

    _TABLES[at] = drop
    atexit.register(drop)
    return at


def tables() -> set[str]:
    """The tables of scratch() that are there now."""
    return set(_TABLES)


def drop_tables(paths: set[str], reader: DataFrame) -> None:
    """Deletes tables that nothing needs any more; all stay if ``reader`` reads one of them."""
    names = {p.rsplit("/", 1)[-1] for p in paths}
    if names and not any(part in names for f in reader.inputFiles() for part in f.split("/")):
        for p in paths & tables():
            _TABLES[p]()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe when executors are lost."""
    at = scratch(df.sparkSession, name)
    few_files(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """The left_semi or left_anti join of ``docs`` with a column of ids. The ids are broadcast while their number is at
    most BROADCAST_IDS, which is counted first; beyond it the join shuffles."""
    ids = checkpointed(ids.select(key).distinct())
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, how)


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped`` (one column). Rows with a null key stay."""
    return by_ids(docs, dropped, "left_anti", key)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a table with a number of its own for each row (ROW), as doc_id may repeat or be null."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def as_text(column: str = "text"):
    """The text as a string; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """The worker's one large state (a tokenizer with its cache, score tables): made on first use; another one takes its place.

    key: what kind of state it is, and what it is made of."""
    if key not in _HELD:
        release(None)
        _HELD[key] = make()
    return _HELD[key]


def release(kind: str | None) -> None:
    """Drops the worker's large state unless it is of this kind: workers outlive the operator that made it."""
    if _HELD and next(iter(_HELD))[0] != kind:
        _HELD.clear()
        trim()


def trim() -> None:
    """Gives freed memory back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows with about ``size`` bytes of text each, to bound memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    trim()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, state: str | None = None) -> DataFrame:
    """mapInArrow with batches of bounded bytes. state: the kind of large state that ``run`` uses; any other that the worker holds goes first.

    The session's own limits stay where they are lower."""
    conf = df.sparkSession.conf
    for key, most in BATCH_LIMITS.items():
        now = conf.get(key, str(most + 1)).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(state)
        yield from run(batches)

    return df.mapInArrow(task, schema)


def map_texts(df: DataFrame, make: Callable[[list[str]], Mapping[str, Sequence]], added: str, column: str = "_text", state: str | None = None) -> DataFrame:
    """``df`` without its text column, with the columns ``added`` (DDL) that ``make`` returns for a batch of texts.

    The other columns pass through as Arrow arrays, so null integers stay exact. state: as in in_arrow()."""
    fields = StructType.fromDDL(added)
    names = [f.name for f in fields]
    kept = [f for f in df.schema if f.name != column and f.name not in names]
    types = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, column)):
            made = make(b.column(column).to_pylist())
            arrays = [b.column(f.name) for f in kept] + [pa.array(made[n], type=types.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + names)

    return in_arrow(df, run, StructType(kept + list(fields)), state)
