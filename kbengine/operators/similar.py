"""Pairs of similar names: all whose sizes allow it are compared by bits, and none is lost."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Names a block; the pairs of two blocks are one row of work.
BLOCK = 4096
#: 64-bit words of a name's bits: for its characters and for its pairs of neighbouring ones.
CHARS, PAIRS = 2, 4


def _within(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """The names of a size that a similar one of ``others`` may have: none without others, before any name is taken apart."""
    size = F.length("name")
    sizes = others.select(size.alias("n")).where("n > 0").distinct()
    fits = sizes.select(F.explode(F.sequence(F.ceil(least * F.col("n") / (2 - least) - 1e-9), F.floor((2 - least) * F.col("n") / least + 1e-9)).cast("array<int>")).alias("size")).distinct()
    return names.withColumn("size", size).join(F.broadcast(fits), "size", "left_semi").select("name")  # a row a size


def _bits(parts: Iterable[str], words: int) -> bytes:
    """A bit for each part and how often it came before."""
    seen: dict[str, int] = {}
    out = 0
    for x in parts:
        k = seen[x] = seen.get(x, 0) + 1
        out |= 1 << zlib.crc32(f"{k}{x}".encode()) % (64 * words)
    return out.to_bytes(8 * words, "little")


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b["names"].to_pylist()
        chars = [b"".join(_bits(x, CHARS) for x in own) for own in names]
        pairs = [b"".join(_bits(map("".join, zip(x, x[1:], strict=False)), PAIRS) for x in own) for own in names]
        yield pa.record_batch([b["block"], b["names"], pa.array(chars, pa.binary()), pa.array(pairs, pa.binary())], names=["block", "names", "chars", "pairs"])


class Block:
    """Names of one size with their bits and characters."""

    def __init__(self, names: list[str], chars: bytes, pairs: bytes):
        self.names, self.size = names, len(names[0])
        self.chars = np.ascontiguousarray(np.frombuffer(chars, np.uint64).reshape(-1, CHARS).T)
        self.pairs = np.frombuffer(pairs, np.uint64).reshape(-1, PAIRS)
        self.code = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).reshape(-1, self.size)


def _candidates(x: Block, y: Block, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the two blocks of all pairs that may have the ratio, and of some that haven't.

    With m and n characters, M of them in equal blocks, a ratio r leaves
    m + n - 2M <= (1 - r)(m + n) characters that only one of the two has, and, as
    there are at most m + n - 2M + 1 equal blocks, 3(1 - r)(m + n) pairs of
    neighbouring characters. Parts that share a bit lessen the difference only.
    """
    most = (1 - least) * (x.size + y.size) + 1e-6
    for lo in range(0, len(x.names), 64):
        apart = sum(np.bitwise_count(x.chars[w, lo : lo + 64, None] ^ y.chars[w]) for w in range(CHARS))
        i, j = np.nonzero(apart <= most)
        i += lo
        close = np.bitwise_count(x.pairs[i] ^ y.pairs[j]).sum(1, dtype=np.int64) <= 3 * most
        yield i[close], j[close]


def _common(x: Block, y: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences; a bit for each character of ``x``, which has 64 at most."""
    letters = np.unique(x.code)
    at = np.zeros((len(x.names), len(letters) + 1), np.uint64)
    rows = np.arange(len(x.names))
    for k in range(x.size):
        at[rows, np.searchsorted(letters, x.code[:, k])] |= np.uint64(1 << k)
    code = np.minimum(np.searchsorted(letters, y.code), len(letters) - 1)
    code = np.where(letters[code] == y.code, code, len(letters))
    v = np.full(len(i), ~np.uint64(0))
    for k in range(y.size):
        u = v & at[i, code[j, k]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _near(x: Block, y: Block, same: bool, least: float) -> Iterator[tuple[str, str]]:
    """Pairs whose longest common subsequence allows the ratio; in one block each pair once."""
    i, j = map(np.concatenate, zip(*_candidates(x, y, least), strict=True))
    if same:
        i, j = i[i < j], j[i < j]
    for lo in range(0, len(i), 1 << 16):
        p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        if x.size <= 64:  # the ratio's equal blocks are one common subsequence
            ok = 2 * _common(x, y, p, q) >= least * (x.size + y.size) - 1e-6
            p, q = p[ok], q[ok]
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            yield x.names[a], y.names[b]


def tasks(df: DataFrame) -> int:
    """So many tasks for work that its bytes don't tell."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b: different names of ``left`` and ``right`` (each with ``name``) whose ratio is ``least`` or more.

    Distinct names of a size are dealt into blocks, and each two blocks whose sizes
    allow the ratio are compared: the work grows with the square of the number of
    distinct names, at some nanoseconds a pair. What the bits leave is held against
    its longest common subsequence, then the ratio itself is computed.
    """
    left, right = left.select("name"), right.select("name")
    left, right = _within(left, right, least), _within(right, left, least)
    every = left.select("name", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select("name", F.lit(False).alias("l"), F.lit(True).alias("r")))
    names = every.groupBy("name").agg(F.max("l").alias("l"), F.max("r").alias("r")).withColumn("size", F.length("name"))
    kinds = names.groupBy("size", "l", "r").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    block = F.concat_ws(":", F.col("size").cast("string"), F.col("l").cast("string"), F.col("r").cast("string"), F.col("part").cast("string")).alias("block")
    dealt = names.join(F.broadcast(kinds), ["size", "l", "r"]).withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))  # a row a size
    blocks = dealt.groupBy(block).agg(F.collect_list("name").alias("names")).mapInArrow(_with_bits, "block string, names array<string>, chars binary, pairs binary")
    ids = kinds.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(block, "size", "l", "r")
    of = lambda d, p: d.select(*(F.col(c).alias(p + c) for c in d.columns))
    order = "(xsize < ysize OR xsize = ysize AND xblock <= yblock) AND (xl AND yr OR yl AND xr)"
    met = of(ids, "x").join(F.broadcast(of(ids, "y")), F.expr(f"{order} AND {least} * (xsize + ysize) <= 2 * xsize + 1e-6"))  # a row a block, without its names
    met = met.join(of(blocks, "x"), "xblock").join(of(blocks, "y"), "yblock").repartition(tasks(left), "xblock", "yblock")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                x, y = (Block(row[p + "names"], row[p + "chars"], row[p + "pairs"]) for p in "xy")
                a, b = [], []
                for s, t in _near(x, y, row["xblock"] == row["yblock"], least):
                    # the ratio depends on the order of the two
                    for one, other, asked in ((s, t, row["xl"] and row["yr"]), (t, s, row["yl"] and row["xr"])):
                        if asked and T.similarity(one, other) >= least:
                            a.append(one)
                            b.append(other)
                yield pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return met.mapInArrow(run, "a string, b string")
