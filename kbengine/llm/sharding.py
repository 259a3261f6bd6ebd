"""Sharding by extendible hashing.

A row's key is 60 bits of a hash of its id and text. Buckets are the prefixes
of the key; starting from the empty prefix, only a bucket over its byte limit
splits, on one more bit, until each fits. The directory is computed from byte
counts of fine prefixes, level by level; rows are read once.

Defined results: null ids and texts hash as empty strings; a row larger than
the limit gets a bucket of its own, ``oversized``; rows that are repeated so
often that no bit tells them apart share the bits and are numbered apart in
``part``; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, written

BITS = 60
#: Bits by which the directory looks further where a fine prefix is still too large.
STEP = 8


def key(doc_id: str = "doc_id", text: str = "text") -> Column:
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def _directory(cells: DataFrame, top: int, bits: int, limit: int) -> DataFrame:
    """cell, depth, bytes, n: the first depth over ``top`` at which the cell's prefix fits; null where none does."""
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    totals = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total"), F.sum("n").alias("rows")).where((F.col("total") <= limit) | (F.col("rows") == 1))
    first = levels.join(totals, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "total")).alias("at"))
    return cells.join(first, "cell", "left").select("cell", F.col("at.depth").alias("depth"), F.col("at.total").alias("total"))


def placed(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, key, shard (its bits), part, depth, n_bytes, shard_bytes, parts (of its key), oversized: a row a document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = written(own.select("doc_id", key().alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "keys")
    total = own.agg(F.sum("n_bytes")).first()[0] or 0
    top, bits = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    out, rest = None, own
    while True:
        cell = F.expr(f"shiftright(key, {BITS - bits})")
        cells = rest.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        directory = written(_directory(cells, top, bits, limit), "directory")
        met = rest.withColumn("cell", cell).join(directory, "cell")
        fit = met.where(F.col("depth").isNotNull()).select("doc_id", "key", "n_bytes", F.col("depth").cast("int").alias("depth"), F.lit(0).cast("long").alias("part"), F.col("total").alias("shard_bytes"), F.lit(1).alias("parts"))
        out = fit if out is None else out.unionByName(fit)
        if directory.where(F.col("depth").isNull()).isEmpty():
            break
        rest = written(met.where(F.col("depth").isNull()).select("doc_id", "key", "n_bytes"), "rest")
        if bits == BITS:
            out = out.unionByName(_numbered(rest, limit))
            break
        top, bits = bits + 1, min(BITS, bits + STEP)
    shard = F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(shiftright(key, {BITS} - depth)), depth, '0') END")
    return out.select("doc_id", "key", shard.alias("shard"), "part", "depth", "n_bytes", "shard_bytes", "parts", (F.col("shard_bytes") > limit).alias("oversized"))


def _parted(same: DataFrame, key_: str, size: str, limit: int) -> DataFrame:
    """Rows that share whole keys, with the ``part`` of each: every part takes as many as fit.

    Rows are numbered within the tasks that hold them, behind those of the tasks
    before, so that a key with a third of all rows is no single task's.
    """
    own = written(same.withColumn("__task", F.spark_partition_id()), "same")
    counts = own.groupBy(key_, "__task").agg(F.count(F.lit(1)).alias("__n"), F.max(size).alias("__most"))
    by = Window.partitionBy(key_)
    before = counts.select(key_, "__task", F.coalesce(F.sum("__n").over(by.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("__most").over(by), F.lit(1)))).alias("__each"))
    place = F.row_number().over(Window.partitionBy(key_, "__task").orderBy(size)) - 1 + F.col("__before")
    return own.join(before, [key_, "__task"]).withColumn("part", F.floor(place / F.col("__each")).cast("long")).drop("__task", "__before", "__each")


def _numbered(same: DataFrame, limit: int) -> DataFrame:
    """Rows that no bit tells apart, in parts."""
    rows = _parted(same, "key", "n_bytes", limit)
    totals = rows.groupBy("key", "part").agg(F.sum("n_bytes").alias("shard_bytes"))
    return rows.join(totals, ["key", "part"]).select("doc_id", "key", "n_bytes", F.lit(BITS).alias("depth"), "part", "shard_bytes", F.lit(2).alias("parts"))


def write(docs: DataFrame, limit: int, path: str) -> None:
    """Write all columns, a folder a shard (its bits and part); ``shard`` and ``part`` give way where the table has them.

    Documents are joined with their shard by id and key. Rows that no bit tells
    apart are equal in both; they are numbered into parts anew, as ``shards`` does.
    """
    own = docs.drop("shard", "part")
    k, size, i, h = (fresh(own, c) for c in ("key", "size", "id", "hash"))
    own = own.withColumns({k: key(), size: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    where = placed(docs, limit).select(F.col("doc_id").alias(i), F.col("key").alias(h), "shard", "part", "parts").dropDuplicates([i, h])
    both = own.join(where, own["doc_id"].cast("long").eqNullSafe(where[i]) & (own[k] == where[h])).drop(i, h)
    alone, more = both.where("parts = 1"), _parted(both.where("parts > 1").drop("part"), k, size, limit)
    columns = [*(f"`{c}`" for c in docs.drop("shard", "part").columns), "shard", "part"]
    alone.select(*columns).unionByName(more.select(*columns)).write.partitionBy("shard", "part").parquet(path)


def shards(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, shard (its bits), part, depth, n_bytes, shard_bytes, oversized: a row a document."""
    return placed(docs, limit).drop("key", "parts")


#: The same rows in SQL for DuckDB; rows repeated beyond the limit apart.
SQL = """
WITH k AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 15))::BIGINT AS key
  FROM documents),
t AS (
  SELECT d, key >> (60 - d) AS p, sum(n_bytes)::BIGINT AS total, count(*) AS n
  FROM k, range(0, 61) r(d) GROUP BY ALL),
a AS (
  SELECT k.doc_id, k.n_bytes, k.key, min(t.d) AS d
  FROM k JOIN t ON t.p = k.key >> (60 - t.d) WHERE t.total <= {limit} OR t.n = 1
  GROUP BY ALL)
SELECT a.doc_id, CASE WHEN a.d = 0 THEN '' ELSE right(repeat('0', 60) || bin(a.key >> (60 - a.d)), a.d::INT) END AS shard,
       0::BIGINT AS part, a.d::INT AS depth, a.n_bytes::BIGINT AS n_bytes, t.total AS shard_bytes, t.total > {limit} AS oversized
FROM a JOIN t ON t.d = a.d AND t.p = a.key >> (60 - a.d)
"""
