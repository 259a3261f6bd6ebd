"""What the operators share: scratch tables, batch limits, words and keys."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split also takes for white space, though the words' definition doesn't.
OTHER_SPACE = ("\x1c\x1d\x1e\x1f", "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")


def words_of(text: str) -> list[str]:
    """The words of a text; str.split finds the same ones faster where no other white space occurs."""
    if any(c in text for c in OTHER_SPACE[0]) or not text.isascii() and any(c in text for c in OTHER_SPACE[1]):
        return WORD.findall(text)
    return text.split()


#: Rows and bytes of one Arrow batch handed to Python; texts can be long.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what a Python worker holds easily."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What this worker process keeps from task to task: of one owner at a time.
_kept: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]):
    """What ``owner`` keeps in this worker process; made anew, and everything else dropped, when another owner had the worker."""
    if owner not in _kept:
        release(owner)
        _kept[owner] = make()
    return _kept[owner]


def release(owner: str = "") -> None:
    """Drop what other owners keep, and give the freed memory back to the system."""
    for k in [k for k in _kept if k != owner]:
        close = getattr(_kept.pop(k), "close", None)
        if close:
            close()
    gc.collect()
    give_back()


def give_back() -> None:
    """Free memory that the allocators hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def alone(owner: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` in a worker that first drops what other owners have left in it, and afterwards what its own batches have, unless the next task is to find it."""

    def run(batches):
        release(owner)
        yield from f(batches)
        if keep:
            give_back()
        else:
            release()

    return run


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a session with a local master, as in tests, gets one of
    its own once; on a cluster that is an error, since a folder of one machine is none of the others'.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="kbengine-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/kbengine/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave, once nothing reads them any more; what a result still reads stays in the shared folder."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: bool = False) -> DataFrame:
    """``f`` over Arrow batches of bounded size. A worker keeps nothing from one task to the next, or with ``keep`` what is of the same module."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(alone(f.__module__, f, keep), schema)


def texts(column: pa.Array) -> list[str]:
    """The batch's texts, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The named column, or nulls where the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def sampled(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those with the least hashes of the keys: the same at any partitioning.

    ``keys`` tell rows apart; a text's hash does as well as the text and is all
    that the sort moves: the rows themselves come by a second pass over ``df``,
    which keeps the rows under the hash of the ``n``-th.
    """
    h = F.xxhash64(*keys)
    hashes = df.select(h.alias("h"))
    share = hashes.count() // (4 * n)
    if share > 1:  # of large tables only about 4 n hashes reach the sort
        hashes = hashes.where(F.pmod(F.xxhash64(F.lit(17), "h"), F.lit(share)) == 0)
    last = hashes.orderBy("h").limit(n).agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
    own = df.where(h <= F.lit(last.h if last.h is not None else 0))
    if share > 1:
        own = own.where(F.pmod(F.xxhash64(F.lit(17), h), F.lit(share)) == 0)
    return own.orderBy(h, *keys).limit(n)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a bitmap of wanted rows; beyond some ten million of them it lets others pass as well.
MAP_BITS = 1 << 24


def bit(value: Column) -> Column:
    """The bit of a 64-bit value in a bitmap."""
    return F.xxhash64(value).bitwiseAND(MAP_BITS - 1)


def bitmap_words(values: DataFrame, hashed: bool = False) -> DataFrame:
    """w, bits: the words with a bit set of the bitmap of the table's one column. Values that are hashes already stand by their low bits."""
    own = F.col(values.columns[0])
    return values.select((own.bitwiseAND(MAP_BITS - 1) if hashed else bit(own)).alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))


def bitmap(values: DataFrame, hashed: bool = False) -> bytes:
    """A bitmap, of fixed size, of the table's one column: what it lacks is in no row, so such rows need no exchange."""
    out = np.zeros(MAP_BITS // 64, np.int64)
    for r in bitmap_words(values, hashed).toLocalIterator():
        out[r.w] = r.bits
    return out.tobytes()


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bits ``at`` are set; ``bits`` are the bitmap's 64-bit words."""
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WordHash(dict):
    """64-bit hashes of words, kept for the words met; emptied beyond ``limit`` words."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), seed=self.seed)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every window of ``k`` values; none where there are fewer."""
    if len(h) < k:
        return np.empty(0, dtype=np.uint64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i : len(h) - k + 1 + i]
    return mix(out)
