"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other
parameters keeps its template. Windows of template words are hashed and joined
with the benchmark's; a document holds an item if it has ``COVERAGE`` of
the item's distinct windows and the slots agree: each value of the item stands
for one value in the document. An item some of whose windows have fewer than
``PLAIN`` plain words is also looked up by its literal
words in lower case, so that its copies are found however many placeholders it
has.

Both sides are tables. A bitmap of fixed size, of the benchmark's windows, keeps
the other windows of the documents from the join; beyond ``BROADCAST_ROWS``
windows the benchmark isn't broadcast, and both sides are dealt by window and a
salt, so that a window which many documents hold is no single task's. The slots of what the join
has found are checked with the whole texts, at every place where the item may stand.

Defined results: null and empty texts hold nothing; an item without words is
held by nothing; an item shorter than a window is one window, also one of numbers only; repeated rows
each give a row; items that repeat an id count as one; an empty benchmark flags
nothing; all columns stay, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAP_BITS, bit, bitmap, fresh, kept, map_arrow, marked, mix, windows, words_of, written

WINDOW = 8
COVERAGE = 0.6
#: Words of a window that aren't placeholders, at least.
PLAIN = 4
AGREE = 0.8
#: Windows of a benchmark that is broadcast, at most (24 bytes each); larger ones are dealt with a salt.
BROADCAST_ROWS, SALTS = 200_000, 16

EDGE = ".,!?;:\"'()[]{}«»“”„"
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
UNITS = frozenset("mm cm m km in ft mi mg g kg t lb oz ml l gal s sec min h hr hrs ms hz khz mhz ghz w kw kwh v a k kb mb gb tb usd eur gbp dollars euros pounds cents meters metres miles feet inches kilometers kilometres grams kilograms liters litres seconds minutes hours days weeks months years percent degrees".split())

CLOSING = "\"')]}»”"
SENTENCE_ENDS = (".", "!", "?", ":")
FLAGS = np.uint64(7)
CAPITAL, ENDS, UNIT = np.uint64(1), np.uint64(2), np.uint64(4)
NUM_HASH, NAME_HASH, UNIT_HASH = (np.uint64(k << 3) for k in (1, 2, 3))


class Words(dict):
    """A word's hash with its flags in the low three bits; emptied when large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        if word.isalpha():
            core, ends = word, False
        else:
            core = word.strip(EDGE)
            ends = word.rstrip(CLOSING)[-1:] in SENTENCE_ENDS
        if not core.isalpha() and NUMBER.fullmatch(core):
            out = 8
        else:
            low = core if core.islower() else core.lower()
            out = max(xxhash.xxh3_64_intdigest(low.encode()) & ~7, 64)
            if low is not core and len(core) > 1 and core[0].isupper() and not core.isupper():  # capitals throughout are no name
                out |= 1
            if low in UNITS:
                out |= 4
        if ends:
            out |= 2
        if len(word) <= 64:
            self[word] = out
        return out

    def literal(self, words: list[str]) -> np.ndarray:
        """Hashes of the words themselves, in lower case."""
        import xxhash

        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words)) & ~FLAGS
        for i in np.flatnonzero(h == NUM_HASH).tolist():
            h[i] = max(xxhash.xxh3_64_intdigest(words[i].strip(EDGE).encode()) & ~7, 64)
        return h

    def template(self, words: list[str]) -> np.ndarray:
        """Hashes of the template's words."""
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        start = np.concatenate([[True], (h[:-1] & ENDS) != 0])
        plain = h & ~FLAGS
        name = ((h & CAPITAL) != 0) & ~start
        after = np.concatenate([[False], plain[:-1] == NUM_HASH])
        return np.where(((h & UNIT) != 0) & after, UNIT_HASH, np.where(name, NAME_HASH, plain))


def template_windows(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows with enough plain words."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    plain = np.concatenate([[0], np.cumsum(h >= 64)])
    at = np.flatnonzero(plain[k:] - plain[:-k] >= min(PLAIN, k))
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return at, mix(out)[at]


@dataclass
class Variant:
    """One way in which an item is looked up."""

    size: int
    literal: bool
    words: list[str]
    h: np.ndarray
    at: np.ndarray
    w: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return keys(self.w, self.size, self.literal)


def keys(w: np.ndarray, size: int, literal: bool) -> np.ndarray:
    """What windows are joined by: windows of other sizes and kinds never meet."""
    return mix(w ^ np.uint64(2 * size + literal)).view(np.int64)


def variants(text: str, known: Words) -> list[Variant]:
    """By its template, with names as words too (a text in capitals doesn't tell names), and by its literal words where few are plain."""
    words = words_of(text)
    k = min(WINDOW, len(words))
    if not k:
        return []
    h = known.template(words)
    plain = known.template([x.lower() for x in words])
    out, few = [], False
    for h in (h,) if np.array_equal(h, plain) else (h, plain):
        at, w = template_windows(h, k)
        few |= len(w) < len(words) - k + 1
        if len(w):
            out.append(Variant(k, False, words, h, at, w))
    if few:
        h = known.literal(words)
        w = windows(h, k)
        out.append(Variant(k, True, words, h, np.arange(len(w)), w))
    return out


def held(v: Variant, words: list[str], h: np.ndarray) -> bool:
    """Whether the text of these words and hashes holds the item: enough windows, and slots that agree."""
    at, w = (np.arange(max(0, len(h) - v.size + 1)), windows(h, v.size)) if v.literal else template_windows(h, v.size)
    distinct = np.unique(v.w)
    order = np.argsort(w, kind="stable")
    at, w = at[order], w[order]
    lo, hi = np.searchsorted(w, v.w, "left"), np.searchsorted(w, v.w, "right")
    if len(np.unique(v.w[hi > lo])) < COVERAGE * len(distinct):
        return False
    # how many of the item's windows stand at each distance between its places and the text's
    apart = np.zeros(len(h) + len(v.h), np.int64)
    for q, a, b in zip(v.at.tolist(), lo.tolist(), hi.tolist(), strict=True):
        apart[at[a:b] - q + len(v.h)] += 1
    whole = np.flatnonzero(apart >= COVERAGE * len(v.w))
    for d in whole[np.argsort(-apart[whole], kind="stable")].tolist():
        if agrees(v, words, [(q, q + d - len(v.h)) for q in v.at.tolist()], w, lo, hi, at):
            return True
    # the windows in several pieces: each where it stands nearest to the commonest distance
    usual = int(apart.argmax()) - len(v.h)
    near = [(q, int(at[a:b][np.abs(at[a:b] - q - usual).argmin()])) for q, a, b in zip(v.at.tolist(), lo.tolist(), hi.tolist(), strict=True) if b > a]
    return agrees(v, words, near, w, lo, hi, at)


def agrees(v: Variant, words: list[str], places: list[tuple[int, int]], w: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> bool:
    """Whether the item's slot values each stand for one value of the text's, in those of the windows that stand at ``places``."""
    slots: dict[int, int] = {}
    where = {q: (a, b) for q, a, b in zip(v.at.tolist(), lo.tolist(), hi.tolist(), strict=True)}
    for q, p in places:
        a, b = where[q]
        i = a + int(np.searchsorted(at[a:b], p))
        if i < b and at[i] == p:
            slots.update((q + j, p + j) for j in range(v.size) if v.h[q + j] < 64)
    seen: dict[tuple[int, str], dict[str, int]] = {}
    for q, p in slots.items():
        ours = seen.setdefault((int(v.h[q]), v.words[q].strip(EDGE)), {})
        value = words[p].strip(EDGE)
        ours[value] = ours.get(value, 0) + 1
    return sum(max(x.values()) for x in seen.values()) >= AGREE * len(slots)


def _known() -> Words:
    return kept(__name__, Words)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().dropDuplicates()


def _windows(items: DataFrame) -> DataFrame:
    """key, item_id, mark (of the item's text), variant, of (its distinct windows), size, literal: a row a window of an item."""

    def run(batches):
        known = _known()
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for item, mark, text in zip(b["item_id"].to_pylist(), b["mark"].to_pylist(), b["text"].to_pylist(), strict=True):
                for n, v in enumerate(variants(text, known)):
                    own = np.unique(v.keys)
                    for col, x in zip(cols, (own.tolist(), *([x] * len(own) for x in (item, mark, n, len(own), v.size, v.literal))), strict=True):
                        col.extend(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, *[pa.int32()] * 3, pa.bool_()), strict=True)], names=["key", "item_id", "mark", "variant", "of", "size", "literal"])

    return map_arrow(items.withColumn("mark", F.xxhash64("text")), run, "key long, item_id long, mark long, variant int, of int, size int, literal boolean")


def _hits(docs: DataFrame, sizes: list[tuple[int, bool]], sieve: bytes) -> DataFrame:
    """doc_id, h, key: the distinct windows of each document that the benchmark may have."""
    shared = docs.sparkSession.sparkContext.broadcast((sizes, sieve))

    def run(batches):
        known, (sizes, sieve) = _known(), shared.value
        bits = np.frombuffer(sieve, np.uint64)
        for b in batches:
            found = []
            for text in b["text"].to_pylist():
                words = words_of(text or "")
                hashes = {literal: (known.literal if literal else known.template)(words) for literal in {x for _, x in sizes}}
                own = [keys(windows(hashes[True], k) if literal else template_windows(hashes[False], k)[1], k, literal) for k, literal in sizes]
                own = np.concatenate([np.empty(0, np.int64), *own])
                found.append(np.unique(own[marked(bits, own & (MAP_BITS - 1))]))
            sizes_ = [len(x) for x in found]
            rows = pa.array(np.repeat(np.arange(len(found)), sizes_))
            yield pa.record_batch([b["doc_id"].take(rows), b["h"].take(rows), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["doc_id", "h", "key"])

    return map_arrow(docs, run, "doc_id long, h long, key long")


def holdings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), items: the sorted ids of the items, for documents that hold any."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    items = _items(benchmark)
    asked = written(_windows(items), "windows")
    sizes = sorted((r.size, r.literal) for r in asked.select("size", "literal").distinct().collect())  # two for each size up to WINDOW
    hits = _hits(own, sizes, bitmap(asked.select("key"), hashed=True)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)))
    asked = asked.select("key", "item_id", "mark", "variant", "of")
    if asked.count() <= BROADCAST_ROWS:
        met = hits.join(F.broadcast(asked), "key")
    else:
        met = hits.join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["key", "salt"])
    enough = met.groupBy("doc_id", "h", "item_id", "mark", "variant").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of")).where(F.col("n") >= COVERAGE * F.col("of"))
    asked_of = enough.join(items.select("item_id", F.xxhash64("text").alias("mark"), F.col("text").alias("item")), ["item_id", "mark"])
    lists = written(asked_of.groupBy("doc_id", "h").agg(F.collect_list(F.struct("item_id", "variant", "item")).alias("asked")), "asked")

    shared = docs.sparkSession.sparkContext.broadcast(bitmap(lists.select("h")))

    def pick(batches):
        bits = np.frombuffer(shared.value, np.uint64)
        for b in batches:
            some = pa.array(np.flatnonzero(marked(bits, b["at"].to_numpy())))
            yield pa.record_batch([b[c].take(some) for c in ("doc_id", "h", "text")], names=["doc_id", "h", "text"])

    texts = map_arrow(own.withColumn("at", bit(F.col("h"))), pick, "doc_id long, h long, text string").dropDuplicates(["doc_id", "h"])
    right = lists.select(F.col("doc_id").alias("id"), F.col("h").alias("hh"), "asked")
    both = texts.join(right, texts["doc_id"].eqNullSafe(right["id"]) & (texts["h"] == right["hh"])).select("doc_id", "h", "text", "asked")

    def check(batches):
        known = _known()
        for b in batches:
            found = []
            for text, asked in zip(b["text"].to_pylist(), b["asked"].to_pylist(), strict=True):
                words = words_of(text)
                hashes = {False: known.template(words), True: known.literal(words)}
                own = set()
                for x in asked:
                    if x["item_id"] not in own:
                        v = variants(x["item"], known)[x["variant"]]
                        if held(v, words, hashes[v.literal]):
                            own.add(x["item_id"])
                found.append(sorted(own))
            yield pa.record_batch([b["doc_id"], b["h"], pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "h", "items"])

    return map_arrow(both, check, "doc_id long, h long, items array<long>").where(F.size("items") > 0)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, kept, contaminated, item_ids (comma-joined): a row a document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    found = holdings(docs, benchmark).select(F.col("doc_id").alias("id"), F.col("h").alias("hh"), "items")
    both = own.join(found, own["doc_id"].eqNullSafe(found["id"]) & (own["h"] == found["hh"]), "left")
    some = F.col("items").isNotNull()
    return both.select("doc_id", (~some).alias("kept"), some.alias("contaminated"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns; only texts whose bit is that of a held one are exchanged."""
    h, maybe = fresh(docs, "h"), fresh(docs, "maybe")
    found = written(holdings(docs, benchmark).select(F.col("doc_id").alias(fresh(docs, "id")), F.col("h").alias(fresh(docs, "hh"))), "held")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(found.select(found.columns[1])))

    def run(batches):
        own = np.frombuffer(bits.value, np.uint64)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(marked(own, b.column(len(b.columns) - 1).to_numpy()))], names=[*b.schema.names[:-1], maybe])

    hashed = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    schema = T.StructType([*hashed.schema.fields, T.StructField(maybe, T.BooleanType())])
    own = map_arrow(hashed.withColumn(maybe, bit(F.col(h))), run, schema)
    rest = own.where(maybe)
    rest = rest.join(found, rest["doc_id"].cast("long").eqNullSafe(F.col(found.columns[0])) & (F.col(h) == F.col(found.columns[1])), "left_anti")
    return own.where(~F.col(maybe)).select(docs.columns).unionByName(rest.select(docs.columns))
