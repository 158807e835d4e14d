"""Shared pieces: checkpoint folder, materialised tables, Arrow batches, vectorised tokenising."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 1 << 19
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Rows of texts travel to Python by at most BATCH_ROWS, unless the session already asks for fewer: batches of the usual 10,000 hold an executor's memory many times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tesseral-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_held: list[set[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, lost executors lose nothing. Inside stored() the table goes at the end."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _held:
        _held[-1].add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except (AttributeError, NotImplementedError):
        # A remote session has no file system of its own: an empty table takes the place of the rows.
        spark.range(0).write.mode("overwrite").parquet(path)


@contextmanager
def stored(spark: SparkSession) -> Iterator:
    """Tables that materialize() stores inside are removed at the end, but for those given to the function that it yields; these belong to the stored() around, if there is one."""
    own: set[str] = set()
    kept: set[str] = set()
    _held.append(own)
    try:
        yield lambda *tables: kept.update(t._stored_path for t in tables)
    finally:
        _held.pop()
        for path in own - kept:
            _remove(spark, path)
        if _held:
            _held[-1].update(kept)


#: A table of at most so many narrow rows (some 40 bytes each) is broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if its count, which its files hold, allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def crc32_of_id(c: Column) -> Column:
    """crc32 of the id written as text; that of the empty text for null."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- vectorised text


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, key: int) -> np.ndarray:
    """n fixed 64-bit numbers that depend on key only."""
    with np.errstate(over="ignore"):
        return _splitmix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(key << 20)) * np.uint64(0x9E3779B97F4A7C15))


mix = _splitmix
_BASE = np.uint64(6364136223846793005)
_BASE_INV = np.uint64(pow(6364136223846793005, -1, 1 << 64))
_SYMBOL = seeds(256, 7)
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_SYMBOL_LOWER = _SYMBOL[_ASCII_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 1 << 24:
            _powers[str(base)] = got
    return got[:n]


class Texts:
    """Some documents as one byte array: data, offsets (one more than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each maximal run without break bytes; words before each document (one more than documents)."""
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~breaks[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """A 64-bit hash of each slice: a polynomial over random symbol values, mixed."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_SYMBOL_LOWER if lower else _SYMBOL)[self.data] * _power(_BASE, len(self.data)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power(_BASE_INV, len(self.data) + 1)[starts])


def chunks(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows of a string array, of about `most` bytes each (one row at least): first row, last row + 1, texts. Null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(hashes: np.ndarray, before: np.ndarray, n: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of n words of one document; first word of each run; runs before each document."""
    per = np.diff(before)
    runs = np.maximum(per - (n - 1), 0)
    counts = np.concatenate(([0], np.cumsum(runs)))
    first = np.arange(counts[-1]) + np.repeat(before[:-1] - counts[:-1], runs)
    mult = seeds(n, key) | np.uint64(1)
    total = np.zeros(len(first), np.uint64)
    for j in range(n):
        total += hashes[first + j] * mult[j]
    return mix(total + np.uint64(n)), first, counts


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- sums of vectors over tasks


def _sum_batches(batches: Iterator[pa.RecordBatch], second: bool) -> Iterator[pa.RecordBatch]:
    key, total = None, None

    def row(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "salt", "data"])

    for batch in batches:
        for block, salt, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            here = (block, 0 if second else salt)
            if here != key:
                if key is not None:
                    yield row(key, total)
                key, total = here, np.zeros(len(data) // 8)
            total += np.frombuffer(data)
    if key is not None:
        yield row(key, total)


def summed_vectors(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of rows(block int, salt int, data: float64 bytes of one length per block), in two levels of tasks. The result has the size of one model, whatever the input."""
    schema = "block int, salt int, data binary"
    for second in (False, True):
        keys = ["block"] if second else ["block", "salt"]
        rows = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it, second=second: _sum_batches(it, second), schema)
    return {r.block: np.frombuffer(bytes(r.data)) for r in rows.collect()}


# ---------------------------------------------------------------- a filter of fixed size before a join

_FILTER_BITS, _FILTER_BLOCK = 1 << 25, 1 << 15


def _bit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        h = batch.column(0).to_numpy()
        for block in np.unique(h // _FILTER_BLOCK):
            own = h[h // _FILTER_BLOCK == block] % _FILTER_BLOCK
            np.bitwise_or.at(blocks.setdefault(int(block), np.zeros(_FILTER_BLOCK // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "bits"])


def likely_in(rows: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose column is not among wanted[key]: a filter of 4 MB, whatever the input, spares a following join the shuffle of rows it would drop. It keeps all rows that join."""
    return split_by(rows, column, wanted, key)[0]


def split_by(rows: DataFrame, column: str, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that likely_in() keeps, and the others, among them those with null."""
    spark = rows.sparkSession
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(_FILTER_BITS)).cast("long")
    dealt = wanted.select(place(key).alias("h")).repartition(F.expr(f"h div {_FILTER_BLOCK}"))
    bits = np.zeros(_FILTER_BITS // 8, np.uint8)
    for r in dealt.mapInArrow(_bit_rows, "block int, bits binary").collect():
        lo = r.block * (_FILTER_BLOCK // 8)
        bits[lo : lo + _FILTER_BLOCK // 8] |= np.frombuffer(bytes(r.bits), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def side(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.num_columns - 1).to_numpy()
            found = (h >= 0) & ((shared.value[np.maximum(h, 0) >> 3] >> (h & 7).astype(np.uint8)) & 1 > 0)
            yield batch.filter(pa.array(found == inside)).drop_columns(["__place"])

    placed = rows.withColumn("__place", F.when(F.col(column).isNull(), F.lit(-1)).otherwise(place(column)))
    return placed.mapInArrow(lambda it: side(it, True), rows.schema), placed.mapInArrow(lambda it: side(it, False), rows.schema)
