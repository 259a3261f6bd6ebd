"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each Python worker keeps an in-memory DuckDB. The distinct pre-tokens of a batch
become rows of token positions; a recursive query joins them with the merge
table and contracts, in every word, the leftmost pair of least rank, until no
pair is left. In words of ``LONG`` bytes or more a step contracts every pair of
the least rank at once, from the left, where no pair with the new token ranks
lower; otherwise the leftmost one alone: the result is the same, and the steps
are as many as there are different merges, not as there are positions.
Decoding aggregates the tokens' bytes in the order of their positions. Words are
independent, so results of distinct words are kept and looked up, within a bound
of bytes.

Defined results: a null or empty text has no tokens and decodes to the empty
text; lone surrogates can't occur in Spark strings; repeated rows and ids each
give a row; an empty table gives no rows; ids that the vocabulary lacks are an
error; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, kept, map_arrow

#: Words from this length on are contracted by ``ENCODE_LONG``; both queries give the same ids.
LONG = 64
#: Bytes of the words that one query contracts.
BYTES_A_QUERY = 1 << 18
#: Bytes of texts that are encoded, and values that are gathered, at a time.
TEXT_BYTES, A_TIME = 1 << 20, 1 << 18
#: Bytes of keys and values that a worker keeps for each direction before it forgets what it used least.
KEPT_BYTES = 36 << 20

ENCODE = """
WITH RECURSIVE state(word, ids, n) USING KEY (word) AS (
  SELECT word, ids, len(ids) FROM words
  UNION ALL
  SELECT s.word, s.ids[:b.pos - 1] || [b.merged] || s.ids[b.pos + 2:], s.n - 1
  FROM state s JOIN (
    SELECT word, (least & 65535)::INT AS pos, (least >> 16)::INT AS merged
    FROM (SELECT p.word, min(m.merged::BIGINT * 65536 + p.pos) AS least
          FROM (SELECT word, unnest(ids) AS l, unnest(ids[2:]) AS r, unnest(range(1, n + 1)) AS pos
                FROM state WHERE n > 1) p
          JOIN merges m ON m.pair = p.l::BIGINT * 65536 + p.r
          GROUP BY p.word)
  ) b ON b.word = s.word
)
SELECT word, ids FROM state ORDER BY word
"""
ENCODE_LONG = """
WITH RECURSIVE state(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM words
  UNION ALL
  SELECT word, list(id ORDER BY pos) FROM (
    SELECT word, pos, CASE WHEN hit THEN merged ELSE l END AS id, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS gone
    FROM (
      SELECT *, merged = least AND CASE WHEN NOT every THEN pos = min(pos) FILTER (merged = least) OVER (PARTITION BY word) WHEN l = r THEN (pos - run) % 2 = 0 ELSE true END AS hit
      FROM (
        SELECT *, max(CASE WHEN l = r AND merged = least AND (before IS NULL OR before <> l) THEN pos END) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM (
          SELECT p.*, m.merged, m.every, lag(l) OVER (PARTITION BY word ORDER BY pos) AS before, min(m.merged) OVER (PARTITION BY word) AS least
          FROM (SELECT word, unnest(ids) AS l, unnest(ids[2:] || [NULL]) AS r, unnest(range(len(ids))) AS pos FROM state) p
          LEFT JOIN merges m ON m.pair = p.l::BIGINT * 65536 + p.r)
        WHERE least IS NOT NULL)))
  WHERE NOT gone GROUP BY word
)
SELECT word, ids FROM state ORDER BY word
"""
#: One thread keeps the subquery's order, so that the aggregate takes the bytes by position.
DECODE = """
SELECT piece, unhex(string_agg(hex, '')) AS bytes
FROM (SELECT p.piece, v.hex
      FROM (SELECT piece, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM pieces) p
      JOIN vocabulary v USING (id) ORDER BY p.piece, p.pos)
GROUP BY piece ORDER BY piece
"""
#: Texts with other white space than single spaces and line feeds are split by the whole pattern at once.
ODD = "  |\n | \n|\n\n|[\t\r\v\f\x01\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Marks what stands for itself among the keys; other keys follow a space.
WHOLE = "\x01"
#: Letters in the pattern's sense, whatever the version of Unicode.
LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
#: A letter, and the signs behind it up to a space or the end: they are a pre-token of their own.
SIGNS = f"({LATIN})([!-/:-@\\[-`{{-~]+)( |$)"


@dataclass(frozen=True)
class Vocabulary:
    """The ranks file's bytes and the pre-token pattern; both of fixed size."""

    ranks: bytes
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def parse(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines()) if a}


#: What an entry of ``Kept`` takes besides its key and values: the dictionary's entry, the number, the edge and the uses.
ENTRY = 150


class Kept:
    """Arrays by key, one behind the other in one array; beyond ``most`` bytes the least used are forgotten."""

    def __init__(self, kind: type, most: int):
        self.kind, self.most = kind, most
        self.place: dict = {}
        self.edge, self.data = np.zeros(1, np.int64), np.empty(0, kind)
        self.uses = np.empty(0, np.int32)
        self.bytes = 0

    def shrink(self) -> None:
        """Keep what was taken twice or more, the most used first, up to half of the bound; uses count half from then on."""
        keys = list(self.place)
        size = np.fromiter(map(len, keys), np.int64, len(keys)) + np.diff(self.edge) * self.data.itemsize + ENTRY
        order = np.argsort(-self.uses, kind="stable")
        order = np.sort(order[(np.cumsum(size[order]) <= self.most // 2) & (self.uses[order] >= 2)])
        self.place = {keys[k]: n for n, k in enumerate(order.tolist())}
        self.data, ends = _gather(self.data, self.edge, order)
        self.edge = np.concatenate([[0], ends]).astype(np.int64)
        self.uses = self.uses[order] // 2
        self.bytes = int(size[order].sum())

    def add(self, keys: list, sizes: np.ndarray, values: np.ndarray) -> None:
        n = len(self.place)
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes)])
        self.data = np.concatenate([self.data, values.astype(self.kind)])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), np.int32)])
        self.bytes += sum(map(len, keys)) + ENTRY * len(keys) + len(values) * self.data.itemsize

    def missing(self, keys: list) -> list:
        """Which of the distinct keys aren't known. The least used are forgotten first where the bound is passed."""
        if self.bytes > self.most:
            self.shrink()
        return [k for k in keys if k not in self.place]

    def take(self, keys: list, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of ``keys[i]`` for each i, one behind the other, and where each ends; the keys are distinct."""
        at = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        self.uses[at] += 1
        return _gather(self.data, self.edge, at[index])


class Codec:
    """One worker's encoder and decoder."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb
        import regex

        ranks = vocabulary.parse()
        bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(vocabulary.pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs, merged = [], []
        for b, i in ranks.items():
            for k in range(1, len(b)):
                if (left := ranks.get(b[:k])) is not None and (right := ranks.get(b[k:])) is not None:
                    pairs.append(left * 65536 + right)
                    merged.append(i)
        pairs, merged = np.array(pairs, np.int64), np.array(merged, np.int32)
        # the least rank of any pair with a token; a merge is done everywhere at once if none with its token comes before it
        least = np.full(max(bytes_of) + 1, 1 << 30, np.int64)
        np.minimum.at(least, pairs >> 16, merged)
        np.minimum.at(least, pairs & 65535, merged)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "96MB", "temp_directory": ""})
        self.db.register("merges_in", pa.table({"pair": pairs, "merged": merged, "every": least[merged] > merged}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.register("vocabulary_in", pa.table({"id": pa.array(list(bytes_of), pa.int32()), "hex": [b.hex() for b in bytes_of.values()]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        self.starts = np.zeros(max(bytes_of) + 1, dtype=bool)
        self.known = np.zeros(max(bytes_of) + 1, dtype=bool)
        for i, b in bytes_of.items():
            self.known[i] = True
            self.starts[i] = b < b"\x80" and not b[:1].isalnum()
        #: Whether any token has the two bytes side by side.
        self.beside = np.zeros(1 << 16, dtype=bool)
        for b in ranks:
            own = np.frombuffer(b, np.uint8).astype(np.int64)
            self.beside[own[:-1] * 256 + own[1:]] = True
        self.encoded = Kept(np.int32, KEPT_BYTES)
        self.decoded = Kept(np.uint8, KEPT_BYTES)

    def close(self) -> None:
        self.db.close()

    def _ids(self, query: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sizes and ids of words that one query contracts."""
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.concatenate([[0], np.cumsum([len(b) for b in words])]).astype(np.int32)
        self.db.register("words", pa.table({"word": np.arange(len(words), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}))
        ids = _table(self.db.sql(query))["ids"].combine_chunks()
        return ids.value_lengths().to_numpy(), ids.flatten().to_numpy()

    def cuts(self, word: bytes) -> list[bytes]:
        """A long word's parts, cut where no token has the two bytes side by side: no merge spans such a place."""
        own = np.frombuffer(word, np.uint8).astype(np.int64)
        at = (np.flatnonzero(~self.beside[own[:-1] * 256 + own[1:]]) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)], strict=True)]

    def contracted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sizes and ids of the words, one behind the other."""
        own = [w.encode() for w in words]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        if len(own) and lengths.max() >= LONG:
            parts = [self.cuts(b) if len(b) >= LONG else [b] for b in own]
            owner = np.repeat(np.arange(len(own)), [len(p) for p in parts])
            own = [b for p in parts for b in p]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
        else:
            owner = np.arange(len(own))
        order, sizes, ids = [], [], []
        for query, some in ((ENCODE, np.flatnonzero(lengths < LONG)), (ENCODE_LONG, np.flatnonzero(lengths >= LONG))):
            for lo, hi in _runs(np.cumsum(lengths[some]) // BYTES_A_QUERY):
                got = self._ids(query, [own[k] for k in some[lo:hi].tolist()])
                order.append(some[lo:hi])
                sizes.append(got[0])
                ids.append(got[1])
        if not order:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        order, sizes, ids = np.concatenate(order), np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return np.bincount(owner, weights=sizes[back], minlength=len(words)).astype(np.int64), _gather(ids, edge, back)[0]

    def pretokens(self, raw: str) -> list[str]:
        """The pre-tokens of a piece; most are a word, with a space before or without."""
        word = raw[1:] if raw[:1] == " " else raw
        return [raw] if word.isascii() and word.isalpha() else self.split(raw)

    def learn(self, keys: list[str]) -> None:
        fresh = self.encoded.missing(keys)
        if not fresh:
            return
        # plain words behind a space are a pre-token each; the others are split
        own = pa.array(fresh, pa.string())
        plain = pc.match_substring_regex(own, f"^{LATIN}+$")
        fresh = own.filter(plain).to_pylist() + own.filter(pc.invert(plain)).to_pylist()
        n = pc.sum(plain).as_py() or 0
        tokens = [self.pretokens(k[1:] if k[:1] == WHOLE else k if k[:1] == "\n" else " " + k) for k in fresh[n:]]
        alone = pc.binary_join_element_wise(pa.scalar(" "), own.filter(plain), "")
        words = pa.concat_arrays([alone, pa.array(chain.from_iterable(tokens), pa.string())]).dictionary_encode()
        sizes, ids = self.contracted(words.dictionary.to_pylist())
        flat, ends = _gather(ids, np.concatenate([[0], np.cumsum(sizes)]), words.indices.to_numpy())
        counts = np.concatenate([np.ones(n, np.int64), np.fromiter(map(len, tokens), np.int64, len(tokens))])
        last = np.concatenate([[0], ends])[np.cumsum(counts)]
        self.encoded.add(fresh, np.diff(last, prepend=0), flat)

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        """The keys of texts in which single spaces and line feeds are all the white space there is; signs behind words are keys."""
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(WHOLE), texts, ""), "\n", " \n")
        return pc.split_pattern(pc.replace_substring_regex(marked, SIGNS, rf"\1 {WHOLE}\2\3"), " ")

    def encode(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text behind the other, and where each text ends.

        A pre-token never spans the place where other text meets a space or
        line feed: texts without runs of white space are cut there first.
        """
        batch = pc.fill_null(batch.cast(pa.string()), "")
        odd = pc.match_substring_regex(batch, ODD).to_numpy(zero_copy_only=False)
        out: list = [None] * len(batch)
        for some in (np.flatnonzero(~odd), np.flatnonzero(odd)):
            if not len(some):
                continue
            texts = batch.take(pa.array(some))
            lists = self._pieces(texts) if not odd[some[0]] else pa.array([[WHOLE + p for p in self.split(t)] for t in texts.to_pylist()], pa.list_(pa.string()))
            words = lists.flatten().dictionary_encode()
            keys = words.dictionary.to_pylist()
            self.learn(keys)
            ids, ends = self.encoded.take(keys, words.indices.to_numpy())
            last = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            edges = np.concatenate([[0], ends])[last]
            for k, a, b in zip(some.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out[k] = ids[a:b]
        return (np.concatenate(out) if out else np.empty(0, np.int32)), np.cumsum([len(x) for x in out], dtype=np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the texts, and where each text ends. Pieces that start at a token with a space, line feed or sign are decoded once."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        begins = np.concatenate([[0], ends[:-1]])[ends > np.concatenate([[0], ends[:-1]])] if len(ends) else ends
        first = self.starts[ids]
        first[begins] = True
        at = np.flatnonzero(first)
        offsets = np.concatenate([at, [len(ids)]]).astype(np.int32) * 4
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, np.int32))]).dictionary_encode()
        keys = pieces.dictionary.to_pylist()
        fresh = self.decoded.missing(keys)
        total = np.cumsum([len(b) for b in fresh]) // (4 * BYTES_A_QUERY)
        for lo, hi in _runs(total):
            part = fresh[lo:hi]
            edges = np.concatenate([[0], np.cumsum([len(b) // 4 for b in part])]).astype(np.int32)
            own = np.frombuffer(b"".join(part), np.int32)
            self.db.register("pieces", pa.table({"piece": np.arange(len(part), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(edges), pa.array(own))}))
            back = pc.cast(_table(self.db.sql(DECODE))["bytes"], pa.large_binary()).combine_chunks()
            start = np.frombuffer(back.buffers()[1], np.int64)[back.offset : back.offset + len(back) + 1]
            self.decoded.add(part, np.diff(start), np.frombuffer(back.buffers()[2], np.uint8)[start[0] : start[-1]])
        out, last = self.decoded.take(keys, pieces.indices.to_numpy())
        return out, np.concatenate([[0], last])[np.searchsorted(at, ends)]


def _gather(data: np.ndarray, edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``at`` of an array with such edges, one behind the other, and where each ends."""
    start = edge[at]
    size = edge[at + 1] - start
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    # some at a time: the places take eight bytes each, however small the values
    for lo, hi in _runs(ends // A_TIME):
        first, n = int(ends[lo] - size[lo]), int(ends[hi - 1])
        out[first:n] = data[np.arange(first, n) + np.repeat(start[lo:hi] - ends[lo:hi] + size[lo:hi], size[lo:hi])]
    return out, ends


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal numbers start and end."""
    if not len(numbers):
        return []
    edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    return list(zip(edges, edges[1:], strict=False))


def _split(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return np.split(values, ends[:-1]) if len(ends) else []


def _table(result) -> pa.Table:
    out = result.arrow()
    return out if isinstance(out, pa.Table) else out.read_all()


def codec(vocabulary: Vocabulary) -> Codec:
    """The codec that this worker process keeps for the vocabulary; workers serve many tasks."""
    own = kept(__name__, dict)
    key = hashlib.sha256(vocabulary.pattern.encode() + vocabulary.ranks).hexdigest()
    if key not in own:
        for c in own.values():
            c.close()
        own.clear()
        own[key] = Codec(vocabulary)
    return own[key]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids: array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = codec(shared.value)
        for b in _parts(batches):
            ids, ends = own.encode(b["text"])
            yield pa.record_batch([b["doc_id"], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(_own(docs), run, "doc_id long, ids array<int>", keep=True)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text, from doc_id, ids; bytes that aren't UTF-8 become replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = codec(shared.value)
        for b in batches:
            ids = [np.array(x or [], np.int64) for x in b["ids"].to_pylist()]
            back = _split(*own.decode(np.concatenate([np.empty(0, np.int64), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)))
            yield pa.record_batch([b["doc_id"], pa.array([x.tobytes().decode(errors="replace") for x in back], pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string", keep=True)


def digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = codec(shared.value)
        for b in _parts(batches):
            ids, ends = own.encode(b["text"])
            back = own.decode(ids, ends)
            sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
            yield pa.record_batch([b["doc_id"], pa.array(np.diff(ends, prepend=0), pa.int64()), sha(_split(ids.astype("<u4"), ends)), sha(_split(*back))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(_own(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep=True)


def _parts(batches):
    """The batches in slices of some ``TEXT_BYTES`` of text, one row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False))
        for lo, hi in _runs(ends // TEXT_BYTES):
            yield b.slice(lo, hi - lo)
            # the allocators would keep what one slice took
            give_back()


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
