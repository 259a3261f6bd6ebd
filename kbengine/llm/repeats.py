"""Finding units of text that occur again: shared by the operators that remove them.

A unit is known by a 128-bit hash and stands at a place: its document and its
number there. A document is its ``doc_id`` and the low 32 bits of its text's
hash, so repeated rows are one document and rows that share an id only are two.
The first place of a unit is that of the least id (null last), then hash, then
number.

Inside a batch, all but the first place of a unit are known to be later ones.
They carry that first place and are dealt evenly; only first places are dealt by
hash. So a unit that a third of all rows hold sends one row a batch to its task,
not one a document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_arrow, mix, texts

IDX = 1 << 31
LAST = (1 << 63) - 1

UNITS = "h1 long, h2 long, doc_id long, at long, first_id long, first_at long, more boolean"


#: Columns that come out of it; a table's own of these names give way.
OWN = ("n_removed", "removed")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long, ``text`` as string, ``n_chars`` where there is one, the other columns as ``rest``, and the text's hash as ``__h``: so no name clashes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars", *OWN)]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(["n_chars"] if "n_chars" in docs.columns else []),
        F.struct(*(F.col(f"`{c}`") for c in others) if others else [F.lit(0).alias("none")]).alias("rest"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(0xFFFFFFFF).alias("__h"),
    )


def units(docs: DataFrame, cut: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Every unit's place; ``cut`` gives numbers and two hashes of a text's units, by its marks as well where ``docs`` has ``__idx``.

    ``first_id`` and ``first_at``: the place of the batch that comes first, null
    for that place itself; ``more``: whether others of the batch follow it.
    """

    def run(batches):
        for b in batches:
            ids = [LAST if x is None else x for x in b["doc_id"].to_pylist()]
            hashes = b["__h"].to_pylist()
            marks = [b[c].to_pylist() for c in marked]
            rows, ats, h1s, h2s = [], [], [], []
            for k, text in enumerate(texts(b["text"])):
                idx, h1, h2 = cut(text, *(m[k] or [] for m in marks))
                if len(idx):
                    rows.append(np.full(len(idx), k))
                    ats.append(hashes[k] * IDX + idx.astype(np.int64))
                    h1s.append(h1)
                    h2s.append(h2)
            if not rows:
                continue
            row, at, h1, h2 = np.concatenate(rows), np.concatenate(ats), np.concatenate(h1s), np.concatenate(h2s)
            doc = np.array(ids, np.int64)[row]
            order = np.lexsort((at, doc, h2, h1))
            row, at, h1, h2, doc = row[order], at[order], h1[order], h2[order], doc[order]
            same = np.zeros(len(row), bool)
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            # a repeated row is the same place
            again = np.zeros(len(row), bool)
            again[1:] = same[1:] & (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
            keep = ~again
            start = np.maximum.accumulate(np.where(~same, np.arange(len(row)), 0))
            n = np.arange(len(row))
            later = (n > start) & keep
            more = np.zeros(len(row), bool)
            more[start[later]] = True
            first_id, first_at = doc[start], at[start]
            h1 = np.where(later, mix(at.view(np.uint64) ^ mix(doc.view(np.uint64))), h1)
            cols = [h1.view(np.int64), h2.view(np.int64), doc, at]
            yield pa.record_batch([*(pa.array(c[keep]) for c in cols), *(pa.array(c[keep], mask=~later[keep]) for c in (first_id, first_at)), pa.array(more[keep])], names=["h1", "h2", "doc_id", "at", "first_id", "first_at", "more"])

    marked = [c for c in ("__idx",) if c in docs.columns]
    return map_arrow(docs.select("doc_id", "text", "__h", *marked), run, UNITS)


def placed(found: DataFrame) -> DataFrame:
    """doc_id, at, first_id, first_at: units with a place that comes before, or their own where none does, and ``many``: whether there is another place."""
    own = Window.partitionBy("h1", "h2")
    first = F.coalesce(F.when(F.col("first_id").isNotNull(), F.struct(F.col("first_id").alias("doc_id"), F.col("first_at").alias("at"))), F.min(F.struct("doc_id", "at")).over(own))
    many = F.col("first_id").isNotNull() | F.col("more") | (F.count(F.lit(1)).over(own) > 1)
    return found.withColumns({"first": first, "many": many}).select("doc_id", "at", F.col("first.doc_id").alias("first_id"), F.col("first.at").alias("first_at"), "many")


#: A unit at another place than its first, in SQL.
LATER = "doc_id != first_id OR at != first_at"


def by_document(places: DataFrame) -> DataFrame:
    """doc_id, __h, __idx: the numbers of the units of each document."""
    return (
        places.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), F.shiftright("at", 31).alias("__h"), F.col("at").bitwiseAND(IDX - 1).cast("int").alias("n"))
        .groupBy("doc_id", "__h")
        .agg(F.collect_set("n").alias("__idx"))
    )


def with_marks(docs: DataFrame, marks: DataFrame, how: str = "left") -> DataFrame:
    """``docs`` of ``keyed`` with each document's ``__idx``."""
    own = marks.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__hh"), "__idx")
    return docs.join(own, docs["doc_id"].eqNullSafe(own["__id"]) & (docs["__h"] == own["__hh"]), how).drop("__id", "__hh")


def rebuilt(marked: DataFrame, cut_out: Callable[[str, list[int]], tuple[str, int, str]], columns: list[str]) -> DataFrame:
    """Texts without their marked units: the documents' ``columns``, and n_removed, removed (start:end of what went).

    A column ``n_chars`` follows the text.
    """
    names = [n for n in marked.columns if n not in ("__h", "__idx")]
    own = marked.select(*names, "__idx")
    at = names.index("text")
    schema = T.StructType([own.schema[n] for n in names] + [T.StructField("n_removed", T.LongType()), T.StructField("removed", T.StringType())])

    def run(batches):
        for b in batches:
            cols = [b.column(i) for i in range(len(names))]
            new, counts, spans = [], [], []
            for t, marks in zip(b.column(at).to_pylist(), b["__idx"].to_pylist(), strict=True):
                if marks:
                    t, n, where = cut_out(t, sorted(marks))
                else:
                    n, where = 0, ""
                new.append(t)
                counts.append(n)
                spans.append(where)
            cols[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                old = cols[k].to_pylist()
                cols[k] = pa.array([len(t) if n else o for t, n, o in zip(new, counts, old, strict=True)], cols[k].type)
            yield pa.record_batch([*cols, pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=[f.name for f in schema])

    out = map_arrow(own, run, schema)
    return out.select(*(F.col(c) if c in names else F.col("rest").getField(c).alias(c) for c in columns if c not in OWN), *OWN)
