"""Helpers that the training-data operators share: the shared work folder, stage tables and byte batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where the session names none."""
    conf = spark.sparkContext.getConf()
    where = conf.get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="gridlark-")
        spark.conf.set(CHECKPOINT_CONF, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/gridlark/{name}-{uuid.uuid4().hex}"


#: While a table is staged: shuffle files go when they are done with, and batches of rows are small, since texts may be long.
WHILE_STAGED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
#: The same for results, which run when the caller likes: the settings of the session that these operators lower, where they are still Spark's defaults.
DEFAULTS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "67108864", "64m"), "spark.sql.parquet.columnarReaderBatchSize": ("4096",)}
#: Bytes that a writing task holds before it writes them.
ROW_GROUP = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands texts over in small batches, unless its user has set the sizes."""
    for name, defaults in DEFAULTS.items():
        if spark.conf.get(name, defaults[0]) in defaults:
            spark.conf.set(name, WHILE_STAGED[name])


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs within holds little: see WHILE_STAGED."""
    before = {k: spark.conf.get(k, None) for k in WHILE_STAGED}
    for k, v in WHILE_STAGED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were staged within it; those made with keep=True at the end of the next outer one, if there is one."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    with tidy(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Give the memory of what is no longer used back, at the end of a task: Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def drop_staged(df: DataFrame) -> None:
    """Remove the files behind a table made by staged()."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, root)


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by folds; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


def text_bytes(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array as one uint8 array, and the n + 1 offsets of its rows; null rows are empty."""
    if pa.types.is_large_string(batch.type) or pa.types.is_large_binary(batch.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = batch.buffers()
    off = np.frombuffer(offsets, kind)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64) if len(batch) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def byte_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) that hold at most `most` bytes each, or a single longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def record_batches(rows: Iterable[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Dicts as record batches of at most `size` rows."""
    block: list[dict] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pa.RecordBatch.from_pylist(block, schema)
            block = []
    if block:
        yield pa.RecordBatch.from_pylist(block, schema)


#: Bits of the maps and counters of the tables below: by the number of rows they are about, within these bounds.
LEAST_BITS, MOST_BITS = 16, 29
BLOCK_BITS = 19


def map_bits(rows: int, each: int = 64) -> int:
    """Bits (as a power of two) of a map for so many rows with about each / 4 keys: at most 64 MB."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, rows) * each - 1).bit_length()))


def bit_map(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each 64-bit hash, by its low `bits` bits. Blocks of 64 KB are made on the executors; the driver gets those."""
    block = min(bits, BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(0).to_numpy()
            for b in np.unique(place >> block).tolist():
                inside = place[place >> block == b] & ((1 << block) - 1)
                marks = np.zeros(1 << block, bool)
                marks[inside] = True
                found = np.packbits(marks, bitorder="little")
                own[b] = own[b] | found if b in own else found
        for b, found in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["block", "bits"])

    place = rows.select(F.col(column).bitwiseAND((1 << bits) - 1).cast("int").alias("place"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    with tidy(rows.sparkSession):
        dealt = place.repartition(max(1, min(32, 1 << (bits - block))), F.shiftright("place", block))
        found = dealt.mapInArrow(run, "block int, bits binary").toArrow()
    for b, raw in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[b << (block - 3) : (b + 1) << (block - 3)] = np.frombuffer(raw, np.uint8)
    return out


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these 64-bit hashes the map may hold."""
    place = hashes.astype(np.int64) & (8 * len(bits) - 1)
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def split_rows(df: DataFrame, column: str, wanted: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Rows whose 64-bit hash the map may hold, and the others, so that only the first are shuffled to meet what the map was made of."""
    place = df.columns.index(column)

    def part(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(has_bit(wanted.value, batch.column(place).to_numpy()) == hit))

        return df.mapInArrow(run, df.schema)

    return part(True), part(False)


@contextlib.contextmanager
def shared_value(spark: SparkSession, value: object) -> Iterator[Broadcast]:
    """A broadcast value, of a size that the caller has bounded, which is destroyed at the end; what reads it is done by then."""
    out = spark.sparkContext.broadcast(value)
    try:
        yield out
    finally:
        out.destroy()
