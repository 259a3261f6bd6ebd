"""Removing repeated runs of lines.

``dedup`` removes whole content-defined chunks: a rolling hash over the last
``SPAN`` line hashes ends a chunk where its low bits are zero, so an inserted
line moves the boundaries near it only. Runs within which no two common
boundaries fall stay.

``dedup_runs``, which the registered queries use, finds the repeated chunks in
the same way and then, for what no chunk covers, exactly every run of two or
more lines with words that occurs anywhere before, in whatever context: each two
neighbouring lines with words that aren't both inside a repeated chunk are
hashed with the white lines between them, and a pair that occurs before goes
once its bytes have been compared with those of the first place. A longer run
is the union of its chunks and pairs.

Defined results: a null text stays null, an empty one empty; repeated rows
(same id, same text) are one document and end up alike; rows that share only an
id are told apart by their text; a null id comes after all others; an empty
table gives no rows; all columns stay, but for ones named ``n_removed`` or
``removed``, which the operator's own replace; ``n_chars`` follows the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import bit, bitmap_words, discard, map_arrow, mix, texts, written

SPAN = 2
#: A chunk ends at one line in so many.
EVERY = 4
MIN_LINES = 2
WHITE = " \t\n\v\f\r"


def chunks(text: str) -> list[str]:
    """The text in chunks of whole lines, two or more where there are as many; they join to the text."""
    lines = _lines(text)
    if len(lines) < 2 * MIN_LINES:
        return [text] if text else []
    h = np.array([xxhash.xxh3_64_intdigest(x.rstrip("\n").encode()) for x in lines], np.uint64)
    rolling = h.copy()
    for k in range(1, SPAN):
        rolling[k:] += mix(h[:-k] + np.uint64(k))
    ends = np.flatnonzero(mix(rolling) % np.uint64(EVERY) == 0) + 1
    out, at = [], 0
    for e in ends.tolist():
        if e - at >= MIN_LINES and (len(lines) - e >= MIN_LINES or e == len(lines)):
            out.append("".join(lines[at:e]))
            at = e
    if at < len(lines):
        out.append("".join(lines[at:]))
    return out


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    lines = [x + "\n" for x in parts[:-1]]
    return [*lines, parts[-1]] if parts[-1] else lines


def counts(chunk: str) -> bool:
    """Whether a chunk has two lines with words: others are never removed."""
    return sum(1 for x in chunk.split("\n") if x.strip(WHITE)) >= MIN_LINES


def _body(chunk: str) -> str:
    """What is compared: without the last line feed, which the text's end lacks."""
    return chunk[:-1] if chunk.endswith("\n") else chunk


def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = [(i, _body(c).encode()) for i, c in enumerate(chunks(text)) if "\n" in c and counts(c)]
    digests = [xxhash.xxh3_128_intdigest(c) for _, c in own]
    half = (1 << 64) - 1
    return np.array([i for i, _ in own], np.int64), np.array([d & half for d in digests], np.uint64), np.array([d >> 64 for d in digests], np.uint64)


def cut_out(text: str, marks: list[int]) -> tuple[str, int, str]:
    gone, kept, spans, at = set(marks), [], [], 0
    for i, c in enumerate(chunks(text)):
        if i in gone:
            spans.append(f"{at}:{at + len(c)}")
        else:
            kept.append(c)
        at += len(c)
    return "".join(kept), len(gone), ",".join(spans)


def worded(text: str) -> list[tuple[int, int]]:
    """Where each line with words starts and ends, without its line feed."""
    out, at = [], 0
    for x in text.split("\n"):
        if x.strip(WHITE):
            out.append((at, at + len(x)))
        at += len(x) + 1
    return out


def cut_pairs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = worded(text)
    digests = [xxhash.xxh3_128_intdigest(text[a[0] : b[1]].encode()) for a, b in zip(at, at[1:])]
    half = (1 << 64) - 1
    return np.arange(len(digests)), np.array([d & half for d in digests], np.uint64), np.array([d >> 64 for d in digests], np.uint64)


def cut_out_pairs(text: str, marks: list[int]) -> tuple[str, int, str]:
    """Marked pairs go; white lines at a run's edges stay, unless no line with words is left."""
    at = worded(text)
    gone = {m for i in marks for m in (i, i + 1)}
    if len(gone) == len(at):
        return "", len(gone), f"0:{len(text)}"
    runs: list[list[int]] = []
    for i in marks:
        a, b = at[i][0], min(at[i + 1][1] + 1, len(text))
        if runs and a <= runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    edges = [0, *(x for r in runs for x in r), len(text)]
    kept = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return "".join(kept), len(gone), ",".join(f"{a}:{b}" for a, b in runs)


def chunk_bodies(text: str, marks: list[int]) -> list[bytes]:
    parts = chunks(text)
    return [_body(parts[i]).encode() for i in marks]


def pair_bodies(text: str, marks: list[int]) -> list[bytes]:
    at = worded(text)
    return [text[at[i][0] : at[i + 1][1]].encode() for i in marks]


def cut_rest(text: str, marks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of lines that aren't inside a marked chunk."""
    inside = set(within(text, marks))
    idx, low, high = cut_pairs(text)
    rest = np.array([i not in inside for i in idx.tolist()], bool)
    return (idx[rest], low[rest], high[rest]) if inside else (idx, low, high)


def within(text: str, marks: list[int]) -> list[int]:
    """The numbers of the pairs of lines inside the marked chunks."""
    if not marks:
        return []
    gone, out, at = set(marks), [], 0
    for i, c in enumerate(chunks(text)):
        n = sum(1 for x in c.split("\n") if x.strip(WHITE))
        if i in gone:
            out += range(at, at + n - 1)
        at += n
    return out


def cut_out_both(text: str, marks: list[int]) -> tuple[str, int, str]:
    """Odd marks are chunks', twice their number and one; even ones are twice a pair's."""
    return cut_out_pairs(text, sorted({m >> 1 for m in marks if not m & 1}.union(within(text, [m >> 1 for m in marks if m & 1]))))


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, texts without repeated chunks, n_removed (chunks) and removed (start:end, code points)."""
    own = repeats.keyed(docs)
    return repeats.rebuilt(repeats.with_marks(own, repeats.by_document(_same(own, repeats.placed(repeats.units(own, cut)).where("many"), chunk_bodies))), cut_out, docs.columns)


def dedup_runs(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, texts without repeated runs of lines, n_removed (lines with words) and removed (start:end, code points)."""
    own = repeats.keyed(docs)
    places = written(repeats.placed(repeats.units(own, cut)).where("many"), "chunks")
    whole = written(_same(_held(own, places)[0], places, chunk_bodies), "repeated")
    discard(places)
    # the first place of a pair is in no repeated chunk, since that chunk's own first place would come before
    rest = repeats.units(_marked(own, whole), cut_rest)
    later = written(repeats.placed(rest).where("many"), "pairs")
    pairs = _same(_held(own, later)[0], later, pair_bodies)
    twice = F.col("at") + F.col("at").bitwiseAND(repeats.IDX - 1)
    both = written(whole.select("doc_id", (twice + 1).alias("at")).unionByName(pairs.select("doc_id", twice.alias("at"))), "gone")
    discard(whole, later)
    return repeats.rebuilt(_marked(own, both), cut_out_both, docs.columns)


def _held(own: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with a place, and by chance others; and the rest, which need no exchange. Told apart by a bitmap of fixed size."""
    words = F.broadcast(bitmap_words(places.select("doc_id")))
    at = bit(F.coalesce("doc_id", F.lit(repeats.LAST)))
    out = own.withColumn("__at", at).join(words.withColumnsRenamed({"w": "__w", "bits": "__bits"}), F.shiftright("__at", 6) == F.col("__w"), "left")
    held = F.coalesce(F.expr("shiftright(__bits, CAST(__at & 63 AS INT)) & 1"), F.lit(0)) == 1
    return tuple(out.where(some).select(own.columns) for some in (held, ~held))


def _marked(own: DataFrame, places: DataFrame) -> DataFrame:
    """``own`` with each document's ``__idx``; only documents with a place are exchanged."""
    held, free = _held(own, places)
    return repeats.with_marks(held, repeats.by_document(places)).unionByName(free.withColumn("__idx", F.lit(None).cast("array<int>")))


def _same(own: DataFrame, places: DataFrame, bodies_of) -> DataFrame:
    """doc_id, at: those of the places whose bytes are those of their first one."""
    asked = repeats.with_marks(own.select("doc_id", "text", "__h"), repeats.by_document(places), "inner")

    def pick(batches):
        for b in batches:
            ids, ats, bodies = [], [], []
            for d, h, t, marks in zip(b["doc_id"].to_pylist(), b["__h"].to_pylist(), texts(b["text"]), b["__idx"].to_pylist(), strict=True):
                ids += [repeats.LAST if d is None else d] * len(marks)
                ats += [h * repeats.IDX + i for i in marks]
                bodies += bodies_of(t, marks)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "at", "body"])

    bodies = map_arrow(asked, pick, "doc_id long, at long, body binary").dropDuplicates(["doc_id", "at"])
    rest = places.where(repeats.LATER).select("doc_id", "at", "first_id", "first_at")
    firsts = bodies.select(F.col("doc_id").alias("first_id"), F.col("at").alias("first_at"), F.col("body").alias("first_body"))
    return rest.join(bodies, ["doc_id", "at"]).join(firsts, ["first_id", "first_at"]).where(F.col("body") == F.col("first_body")).select("doc_id", "at")
