"""What the operators share: the shared folder, batch sizes, gapless ranks and hashing of words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python. Texts may be long, so batches are short.
BATCH_ROWS = 256


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Points checkpoints at the folder that the cluster shares and keeps Arrow batches short.

    The folder is the one named in ``spark.checkpoint.dir``; only where that is
    unset (tests, a laptop) a temporary folder is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder, which survives lost executors."""
    prepare(df.sparkSession)
    done = df.checkpoint(eager=True)
    trim(df.sparkSession)
    return done


def trim(spark: SparkSession) -> None:
    """Gives memory that the driver's JVM has freed outside of its heap back to the system.

    The C library holds such memory for each of the JVM's threads, of which large plans have hundreds, so that
    it piles up from step to step. A JVM without the command, as on other systems than Linux, keeps it.
    """
    sc = spark.sparkContext
    java = sc._jvm
    server, name = java.java.lang.management.ManagementFactory.getPlatformMBeanServer(), java.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")

    def call(method: str, *args: object) -> JavaObject:
        # Through the interface: the server's own class is not open to Py4J.
        own = next(m for m in java.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == method)
        given = sc._gateway.new_array(java.java.lang.Object, len(args))
        for i, x in enumerate(args):
            given[i] = x
        return own.invoke(server, given)

    if any(x.getName() == "systemTrimNativeHeap" for x in call("getMBeanInfo", name).getOperations()):
        call("invoke", name, "systemTrimNativeHeap", None, None)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files and checkpoints that nothing refers to any more.

    Spark does so when the driver's JVM happens to collect its garbage, which with a large heap is seldom, so
    that the files of all steps pile up. Lineage must have been cut and the frames before it must be out of scope.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


_KEPT: dict[str, dict] = {}


def keep(name: str, store: dict) -> None:
    """Tells make_room() of a store that a Python worker keeps from task to task."""
    _KEPT[name] = store


def make_room(but: str | None = None) -> None:
    """Drops what operators keep in this Python worker, all stores or all ``but`` one, and gives freed memory back to the system.

    Workers outlive their tasks, so that otherwise each operator's memory adds to that of the ones before.
    """
    for name, store in _KEPT.items():
        if name != but:
            store.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library has it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], but: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with make_room() before and after it.

    An executor hands its Python workers to tasks in turn. A plan with two Python steps in a task leaves it twice
    as many workers as it has cores, and what a task leaves in its worker is held by all of them at once.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(but)
        try:
            yield from run(batches)
        finally:
            make_room(but)

    return tidied


def gapless_rank(df: DataFrame, key: str, order: list[Column], chunk: Column, chunks: int, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each value of ``key``, without one task for a whole key.

    ``chunk`` is an int in [0, chunks). Rows are numbered within (key, chunk) and
    shifted by the rows of earlier chunks. The shifts have at most keys x chunks
    rows, so callers with a bounded number of keys may broadcast them.
    """
    parts = df.withColumn("_t_chunk", chunk)
    counts = parts.groupBy(key, "_t_chunk").agg(F.count(F.lit(1)).alias("_t_n"))
    before = Window.partitionBy(key).orderBy("_t_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(key, "_t_chunk", F.coalesce(F.sum("_t_n").over(before), F.lit(0)).alias("_t_shift"))
    within = Window.partitionBy(key, "_t_chunk").orderBy(*order)
    numbered = parts.withColumn("_t_row", F.row_number().over(within))
    joined = numbered.join(F.broadcast(shifts), [key, "_t_chunk"])
    return joined.withColumn(out, (F.col("_t_shift") + F.col("_t_row") - 1).cast("long")).drop("_t_chunk", "_t_row", "_t_shift")


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("base", ())) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        for name, base in (("base", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["base"][:n], _POWERS["inverse"][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``text``; words are runs of bytes other than ASCII white space."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    black = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(black.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start])


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles; fewer words make one shingle, none make none."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - size + 1 + i])
    return np.unique(h)


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


#: The most keys that go in a filter, its bits for each key, and log2 of its least and most bits: 16 MB at most.
#: Beyond so many keys callers shuffle all rows.
FILTER_KEYS, FILTER_RATIO, FILTER_BITS = 1 << 24, 128, (20, 27)


class KeyFilter:
    """A bit map of hashed 64-bit keys. It lets some others through, by a rate that does not grow with the corpus."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.shift = packed, np.uint64(64 - (len(packed) * 8).bit_length() + 1)

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.int64).view(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys.astype(np.int64).view(np.uint64) * np.uint64(_BASE)) >> self.shift).astype(np.int64)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def key_filter(keys: DataFrame) -> Broadcast | None:
    """A broadcast KeyFilter of a column of longs; None if they are more than FILTER_KEYS."""
    spark = keys.sparkSession
    n = keys.count()
    if n > FILTER_KEYS:
        return None
    bits = min(max((n * FILTER_RATIO).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(1 << bits, bool)
        for b in batches:
            hit[KeyFilter.slots(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(hit).tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in keys.coalesce(4).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast(KeyFilter(out))
