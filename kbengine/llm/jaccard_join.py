"""Exact n-gram Jaccard join with PartEnum signatures.

A document's set is its distinct five-word shingles, as 64-bit hashes. Two sets
of sizes a and b with Jaccard similarity of 0.8 or more differ in (a + b) / 9
elements at most. Bands of sizes overlap so that any two such sets have a band in
common; in a band whose largest sets have t elements, a set of n differs from a
similar one in k = (n + min(t, 5n / 4)) / 9 at most.

In a band the domain is dealt by hash to ``n1`` first-level partitions of ``n2``
cells each. As ``n1 * (k2 + 1) > k``, in some first-level partition the two sets
differ in ``k2`` cells at most, so they agree on one of the subsets of
``n2 - k2`` of its cells: every such subset with elements is enumerated, and its
elements are a signature. Larger subsets cost more signatures, half as many again
for ``n2`` 3 and ``k2`` 1, which bands of middle size have (``ENUMERATED``); beside
them a first-level partition is one cell (``n2`` 1, ``k2`` 0).

Subsets without elements tell nothing and give no signature. Therefore ``n1`` is
larger than needed, and where a set has too many empty cells even so, it also
signs in a second round, whose partitions are dealt by another hash, and so on;
in the last round subsets without elements sign as well. Of two similar sets
either one has enough filled cells in a round that both sign in, or both go on
to the next: so no pair is lost. The first round leaves out elements that are
common in a bounded sample, so that passages which many documents share hardly
make signatures; two sets differ in no more elements without them. The sample
changes the work, never the result.

Equal sets are one node. Candidates that share a signature are verified by
their whole sets: first each against the least node of its group, then neighbours
in groups that still span several components, by size and by hash; at last every
pair of different components in what spans several even then, in blocks. Nodes of
a batch with one signature follow the least of them, which alone goes through the
exchange: a signature that a third of all rows have sends a row a batch.

Defined results: without words or text a document is empty, has no shingles and
is linked with nothing (its component is its own id); with fewer than five words
the whole sequence is its one shingle; repeated rows and ids give a row each; a
null id takes the least id of its component, null if there is none; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHash, bit, bitmap, discard, fresh, kept, map_arrow, marked, mix, sampled, windows, written

K = 5
#: A band's largest size, times that of the band before.
RATIO = 2
#: In bands whose largest sets have so many elements cells are enumerated.
ENUMERATED = (24, 256)
#: Rounds with other partitions, of which the last signs by empty cells too.
ROUNDS = 5
#: The sample that tells common shingles: documents, characters of each, documents that hold a common one, and their number at most.
SAMPLE_ROWS, SAMPLE_CHARS, COMMON, MOST = 3000, 20_000, 4, 200_000


class _Bytes(WordHash):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the shingles; bytes.lower and bytes.split treat ASCII letters and white space only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = kept(__name__, lambda: _Bytes(300_000)).of(words)
    if len(words) < K:
        return mix(windows(h, len(h)) ^ np.uint64(len(words)))
    return np.unique(windows(h, K))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set; the first is a node's name."""
    a = mix(np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], np.uint64) + np.uint64(len(s)))[0]
    b = mix(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(0x1234567)))], np.uint64) ^ np.uint64(len(s)))[0]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities: bit i tells whether an odd number of elements fall on it; 2 to 4 bits an element.

    Two sets differ in at least as many elements as their sketches differ in bits.
    """
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ np.uint64(0x51ED270B)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: bytes, size: int) -> np.ndarray:
    """A sketch as 64-bit words, folded to ``size`` bytes."""
    w = np.frombuffer(x, np.uint64)
    while len(w) * 8 > size:
        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    return w


def may_link(x: bytes, n: int, y: bytes, m: int) -> bool:
    """False where sizes and sketches already tell that two sets aren't similar enough."""
    if 100 * min(n, m) < 80 * max(n, m):
        return False
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= (n + m) // 9


def _among(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    if not len(own):
        return np.zeros(len(x), bool)
    at = np.searchsorted(own, x)
    at[at == len(own)] = 0
    return own[at] == x


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``top`` elements."""

    low: int
    top: int

    @property
    def cells(self) -> tuple[int, int]:
        """n2 and k2."""
        return (3, 1) if ENUMERATED[0] <= self.top <= ENUMERATED[1] else (1, 0)

    def needed(self, n: int) -> int:
        """First-level partitions of which one, in a set of ``n`` elements and any similar one of the band, has no more than k2 cells that differ."""
        k = (n + min(self.top, n * 5 // 4)) // 9
        return k // (self.cells[1] + 1) + 1

    def first(self, round_: int) -> int:
        """n1: so many more than the largest sets need that few of them lack filled ones."""
        n2, k2 = self.cells
        n1 = needed = self.needed(self.top)
        while n1 < 4 * needed + 4:
            empty = exp(-self.top / (n1 * n2))
            lacking = empty if k2 == 0 else empty**n2 + n2 * empty ** (n2 - 1) * (1 - empty)
            if n1 * (1 - lacking) - (1 + 2 * round_) * sqrt(n1 * lacking * (1 - lacking)) >= needed:
                break
            n1 += 1
        return n1


@cache
def bands(n: int) -> tuple[tuple[int, Band], ...]:
    """The numbered bands that sets of ``n`` elements belong to."""
    out, j, before, top = [], 0, 0, 6
    while (low := -(-4 * (before + 1) // 5)) <= n:
        if n <= top:
            out.append((j, Band(max(4, low), top)))
        j, before, top = j + 1, top, top * RATIO
    return tuple(out)


@cache
def layout(j: int, band: Band, round_: int) -> tuple[int, np.ndarray, list[np.uint64]]:
    """n1, a constant for each first-level partition, and one for each subset of cells."""
    n1 = band.first(round_)
    tag = np.uint64(1 + j + (round_ << 8))
    subsets = list(combinations(range(band.cells[0]), band.cells[0] - band.cells[1]))
    place = mix(np.arange(n1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tag)
    return n1, place, [np.uint64((1 + c) * 0x9E3779B97F4A7C15 % (1 << 64)) for c in range(len(subsets))]


def signatures(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set's signatures, one for each enumerated subset with elements."""
    n = len(s)
    if n < 4:  # a partner of another size would be less than 0.8 similar
        return np.empty(0, np.uint64)
    rare = s[~_among(s, common)] if len(common) else s
    out = []
    for j, band in bands(n):
        n2, k2 = band.cells
        for round_ in range(ROUNDS):
            own = rare if round_ == 0 else s
            n1, place, names = layout(j, band, round_)
            tag = np.uint64(1 + j + (round_ << 8))
            h = mix(own ^ (tag << np.uint64(40)))
            cell = (h % np.uint64(n1 * n2)).astype(np.int64)
            order = np.argsort(cell)
            at = cell[order]
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            total = np.zeros(n1 * n2, np.uint64)
            if len(at):
                total[at[begin]] = np.add.reduceat(mix(h + tag)[order], begin)
            filled = np.zeros(n1 * n2, bool)
            filled[at[begin]] = True
            total, filled = total.reshape(n1, n2), filled.reshape(n1, n2)
            last = round_ == ROUNDS - 1
            for name, subset in zip(names, combinations(range(n2), n2 - k2), strict=True):
                some = filled[:, subset].any(1) | last
                out.append(mix(mix(total[:, subset].sum(1, dtype=np.uint64) + place) + name)[some])
            if int((filled.sum(1) > k2).sum()) >= band.needed(n):
                break
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < 80 * len(large):
        return False
    both = int(_among(small, large).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _nodes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, h, n, node, check, sketch, sigs, leads, more: a row a document; no node without shingles.

    Signatures stand with one document of each node of a task. ``leads`` has for
    each the least node of the batch with that signature, null for that node
    itself, and ``more`` whether others of the batch follow it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            n, node, check, sketches, sigs = [], [], [], [], []
            for t in b["text"].to_pylist():
                s = shingles(t)
                x, y = fingerprint(s) if len(s) else (None, None)
                n.append(len(s))
                node.append(x)
                check.append(y)
                sketches.append(sketch(s) if len(s) >= 4 else None)
                sigs.append(np.empty(0, np.int64) if len(s) < 4 or x in seen else signatures(s, shared.value).view(np.int64))
                if x is not None:
                    seen.add(x)
            sizes = np.array([len(x) for x in sigs], np.int64)
            flat = np.concatenate([np.empty(0, np.int64), *sigs])
            own = np.repeat(np.array([x or 0 for x in node], np.int64), sizes)
            order = np.lexsort((own, flat))
            new = np.diff(flat[order], prepend=flat[order[:1]] - 1) != 0
            start = np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))
            lead, follows, more = np.empty_like(own), np.empty(len(flat), bool), np.zeros(len(flat), bool)
            lead[order], follows[order] = own[order][start], ~new
            more[order[start[~new]]] = True
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, x) for x in (pa.array(flat), pa.array(lead, mask=~follows), pa.array(more))]
            yield pa.record_batch(
                [b["doc_id"], b["h"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(sketches, pa.binary()), *lists],
                names=["doc_id", "h", "n", "node", "check", "sketch", "sigs", "leads", "more"],
            )

    return map_arrow(docs.withColumn("h", F.xxhash64("text")), run, "doc_id long, h long, n long, node long, check long, sketch binary, sigs array<long>, leads array<long>, more array<boolean>")


def _groups(nodes: DataFrame) -> DataFrame:
    """sig, least, node: the nodes of each signature that several have, with one that stands before each of them but the first."""
    each = nodes.where(F.size("sigs") > 0).select("node", F.explode(F.arrays_zip("sigs", "leads", "more")).alias("x")).select("node", F.col("x.sigs").alias("sig"), F.col("x.leads").alias("lead"), F.col("x.more").alias("more"))
    own = Window.partitionBy("sig")
    leaders = each.where("lead IS NULL").select("sig", "node", "more", F.min("node").over(own).alias("least"), F.max("node").over(own).alias("most"))
    leaders = leaders.where("more OR least != most").select("sig", "least", "node")
    return leaders.unionByName(each.where("lead IS NOT NULL").select("sig", F.col("lead").alias("least"), "node")).distinct()


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles that many different sets of a bounded sample hold."""

    def run(batches):
        for b in batches:
            own = [shingles(t) for t in b["text"].to_pylist()]
            yield pa.record_batch([pa.array([x.tobytes() for x in own], pa.binary())], names=["s"])

    sample = sampled(docs, SAMPLE_ROWS, "doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    sets = {r.s for r in map_arrow(sample, run, "s binary").toLocalIterator() if r.s}
    if not sets:
        return np.empty(0, np.uint64)
    value, count = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in sets]), return_counts=True)
    value, count = value[count >= COMMON], count[count >= COMMON]
    return np.sort(value[np.lexsort((value, -count))[:MOST]])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, s: the sets of the nodes that ``wanted`` has, each with a document's id."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("doc_id")))

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint64)
        for b in batches:
            at = b["at"].to_numpy()
            some = np.flatnonzero(marked(bits, at))
            nodes, own = [], []
            for t in b["text"].take(pa.array(some)).to_pylist():
                s = shingles(t)
                if len(s) >= 4:
                    nodes.append(fingerprint(s)[0])
                    own.append(s.tobytes())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(own, pa.binary())], names=["node", "s"])

    own = map_arrow(docs.select(bit(F.col("doc_id")).alias("at"), "text"), run, "node long, s binary")
    return own.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _close(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Those of the pairs a, b that sizes and sketches leave."""
    of = lambda x: named.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))

    def run(batches):
        for b in batches:
            ok = [may_link(*x) for x in zip(b["sa"].to_pylist(), b["na"].to_pylist(), b["sb"].to_pylist(), b["nb"].to_pylist(), strict=True)]
            keep = b.filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch([keep["a"], keep["b"]], names=["a", "b"])

    met = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "na", "sb", "nb")
    return map_arrow(met, run, "a long, b long")


def _verified(docs: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs a, b that are similar enough, by their whole sets."""
    pairs = written(pairs, "close")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(nodes.join(named, "node").select("node", "doc_id"), "wanted")
    sets = _sets(docs, wanted)
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    x = x.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")

    def run(batches):
        for batch in batches:
            ok = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True)]
            keep = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch([keep["a"], keep["b"]], names=["a", "b"])

    out = written(map_arrow(x.select("a", "b", "sa", "sb"), run, "a long, b long"), "verified")
    discard(pairs, wanted)
    return out


#: Rows of a group that are compared in one go; larger groups are compared in blocks.
GROUP = 2048


def _spanning(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, node, label, blocks: the rows of groups with several labels. Many signatures have the same members: one of them stays."""
    of = groups.select("sig", "node").join(labels.select("node", "label"), "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
    spans = of.groupBy("sig").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c"), F.min("node").alias("a"), F.max("node").alias("b"),
        F.bit_xor(F.xxhash64("node")).alias("u"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("v"),
    )
    spans = spans.where("x != y").groupBy("c", "a", "b", "u", "v").agg(F.min("sig").alias("sig"))
    return written(of.join(spans.select("sig", F.ceil(F.col("c") / GROUP).cast("int").alias("blocks")), "sig"), "rest")


def _between(rest: DataFrame, named: DataFrame) -> DataFrame:
    """a, b: pairs of a group with different labels that sizes and sketches leave.

    A group (one signature) goes to tasks as pairs of blocks of ``GROUP`` rows,
    where only close pairs come out.
    """
    own = rest.join(named.select("node", "n", "sketch"), "node")
    own = own.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("sig", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "node", "label", "n", "sketch")

    def run(batches):
        held = None
        for b in batches:
            part = {c: b[c].to_numpy() if c != "sketch" else np.array(b[c].to_pylist(), object) for c in b.schema.names}
            if held:
                part = {c: np.concatenate([held[c], v]) for c, v in part.items()}
            new = np.flatnonzero(np.any([np.diff(part[c]) != 0 for c in ("sig", "x", "y")], axis=0)) + 1
            edges = [0, *new.tolist()]
            yield _pairs([{c: v[i:j] for c, v in part.items()} for i, j in zip(edges, edges[1:], strict=False)])
            held = {c: v[edges[-1] :] for c, v in part.items()}
        if held:
            yield _pairs([held])

    dealt = own.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y", "node")
    return map_arrow(dealt, run, "a long, b long").distinct()


def _pairs(groups: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """The close pairs of different labels within groups, or between their two blocks; nodes are in order."""
    out = [np.empty((0, 2), np.int64)]
    for g in groups:
        node, label, n = g["node"], g["label"], g["n"]
        if len(node) < 2 or (label == label[0]).all():
            continue
        side = g["i"] == g["x"]
        one = g["x"][0] == g["y"][0]
        least = min(map(len, g["sketch"]))
        words = np.stack([folded(x, least) for x in g["sketch"]])
        at = np.arange(len(node))
        for k in np.flatnonzero(side):
            met = (label != label[k]) & (100 * np.minimum(n, n[k]) >= 80 * np.maximum(n, n[k]))
            met &= at > k if one else ~side
            met = np.flatnonzero(met)
            if len(met):
                met = met[np.bitwise_count(words[met] ^ words[k]).sum(1) <= (n[met] + n[k]) // 9]
                out.append(np.stack([np.minimum(node[met], node[k]), np.maximum(node[met], node[k])], axis=1))
    both = np.unique(np.concatenate(out), axis=0)
    return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each component, for all nodes with a link.

    Labels shrink to the least among neighbours and then to their label's own,
    which halves long chains; each round is written, so lost executors cost one.
    """
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        settled = new.where("label != old").isEmpty()
        discard(labels)
        labels = new
        if settled:
            discard(both)
            return labels


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row a document."""
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents with the least id of their component, and the empty ones, with all their columns; repeated rows once."""
    h = fresh(docs, "h")
    own = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    gone = classes(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(fresh(own, "id")), F.col("h").alias(fresh(own, "hh"))).distinct()
    left = own.join(gone, own["doc_id"].cast("long").eqNullSafe(F.col(gone.columns[0])) & (F.col(h) == F.col(gone.columns[1])), "left_anti")
    return left.dropDuplicates(["doc_id", h]).select(docs.columns)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, component_id: a row a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(_nodes(docs, _common(docs)), "signed")
    nodes = written(signed.select("doc_id", "h", "n", "node"), "nodes")
    # two different sets with one name would be joined wrongly: stop instead
    named = signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"),
        F.when((F.min("check") != F.max("check")) | (F.min("n") != F.max("n")), F.raise_error(F.lit("two sets with one fingerprint"))).alias("clash"),
    )
    named = written(named, "named")
    groups = written(_groups(signed), "groups")
    discard(signed)

    # each node against the least of its groups, one round for the least of these, then the rest
    star = groups.where(F.col("node") != F.col("least")).select(F.col("node").alias("b"), F.col("least").alias("a")).distinct()
    close = written(_close(star, named), "star")
    tried = written(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    discard(close)
    links = [_verified(docs, named, tried)]
    labels = components(links[0])
    done = [tried]

    def more(pairs: DataFrame, name: str) -> None:
        """Verify pairs that haven't been tried, and join what they link."""
        nonlocal labels
        known = functools.reduce(DataFrame.unionByName, done)
        new = written(pairs.join(known, ["a", "b"], "left_anti"), name)
        if new.isEmpty():
            discard(new)
            return
        links.append(_verified(docs, named, new))
        old, labels = labels, components(functools.reduce(DataFrame.unionByName, links))
        discard(old)
        done.append(new)

    # Neighbours in a group by size, then by hash, join what the star has left apart: a linear number of pairs a round.
    for order in ((F.col("n"), F.col("node")), (F.xxhash64("node"),)):
        spanning = _spanning(groups, labels)
        rest = spanning.join(named.select("node", "n"), "node")  # in parts of some ``GROUP`` rows, so that no group is one task's
        by = Window.partitionBy("sig", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))).orderBy(*order)
        chain = rest.select("node", "label", F.lag("node").over(by).alias("other"), F.lag("label").over(by).alias("theirs")).where("label != theirs")
        more(_close(chain.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), named), "chain")
        discard(spanning)
    # what still spans several components: every pair of different components that may be similar is verified
    spanning = _spanning(groups, labels)
    more(_between(spanning, named), "between")
    discard(spanning, groups, *done, *links)
    labels = labels.select("node", "label")

    found = nodes.join(labels, "node", "left").select("doc_id", "h", "n", F.coalesce("label", "node").alias("label"))
    least = named.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), "doc_id", "clash").groupBy("label").agg(F.min("doc_id").alias("least"), F.max("clash").alias("clash"))
    return found.join(least, "label", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("clash").isNull(), F.coalesce("least", "doc_id")).alias("component_id"))
