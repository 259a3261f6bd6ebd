"""Removing repeated passages by sliding sentence spans.

From every sentence starts a span, and at every sentence ends one: the shortest
run of two or more sentences with ``MIN_WORDS`` words or more. Together they
cover every sentence of any repeated run of so many sentences and words, up to
its last. A text of several sentences with fewer words is one span. Spans are
hashed and joined over all documents; a sentence covered by a span that occurs
before is removed. ``dedup`` knows only the spans that start at a sentence;
the registered query uses ``dedup_runs``. A long
sentence counts as several, cut after the words that have the least hash of
some ``PIECE`` neighbouring ones. So a passage of a long sentence is cut alike
wherever it stands, in pieces of at most ``PIECE`` words, but for its words
before its first common cut and after its last, fewer than ``PIECE`` each; those
edges stay.

Defined results: a null text stays null, an empty one empty; repeated rows
(same id, same text) are one document and end up alike; rows that share only an
id are told apart by their text; a null id comes after all others; an empty
table gives no rows; all columns stay, but for ones named ``n_removed`` or
``removed``, which the operator's own replace; ``n_chars`` follows the text.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from . import repeats
from .common import WORD, WordHash, mix, words_of

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+$")
MIN_WORDS = 20
LONG = 24
PIECE = 12


def sentences(text: str) -> tuple[list[int], list[list[str]]]:
    """Where each sentence starts, with the text's end after the last, and their words."""
    starts, words = [0], []
    for m in SENTENCE.finditer(text):
        own = words_of(m[0])
        if not own:  # joins the sentence before
            if words:
                starts[-1] = m.end()
            continue
        if len(own) > LONG:
            at = [w.start() for w in WORD.finditer(text, m.start(), m.end())]
            edges = cuts(own)
            for a, b in zip([0, *edges], [*edges, len(own)]):
                words.append(own[a:b])
                starts.append(at[b] if b < len(own) else m.end())
        else:
            words.append(own)
            starts.append(m.end())
    if words:
        starts[-1] = len(text)
    return starts, words


def cuts(words: list[str]) -> list[int]:
    """Where a long sentence is cut: behind the words of least hash among any ``PIECE`` neighbours."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    near = np.lib.stride_tricks.sliding_window_view(h, PIECE)
    at = np.unique(near.argmin(1) + np.arange(len(near))) + 1
    return at[at < len(words)].tolist()


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First sentences of spans, and the sentences after their last."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    n = len(lengths)
    ends = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS), np.arange(n) + 2)
    ok = np.flatnonzero(ends <= n)
    return ok, ends[ok]


def runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for spans from and up to every sentence, each once, by place; a text with too few words for one is a span."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    n = len(lengths)
    if n >= 2 and total[-1] < MIN_WORDS:
        return np.array([0]), np.array([n])
    first, end = spans(lengths)
    last = np.arange(n) + 1
    start = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1, last - 2)
    ok = start >= 0
    both = np.unique(np.concatenate([first, start[ok]]) * (n + 1) + np.concatenate([end, last[ok]]))
    return both // (n + 1), both % (n + 1)


def cutter(of=spans):
    """Units of a text; spans from sentences are numbered by their first, others in order."""
    known = WordHash()

    def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, words = sentences(text)
        first, end = of(np.array([len(w) for w in words], np.int64))
        if not len(first):
            none = np.empty(0, np.uint64)
            return first, none, none
        flat = [w for own in words for w in own]
        h = known.of(flat)
        total = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        out = []
        for seed in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            # polynomial prefix hashes modulo 2^64 with an odd base: a span's hash is its prefix difference times the base's power
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), seed)]), dtype=np.uint64)
            prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ seed) * power[:-1], dtype=np.uint64)])
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), np.uint64(pow(int(seed), -1, 1 << 64)))]), dtype=np.uint64)
            a, b = total[first], total[end]
            out.append(mix((prefix[b] - prefix[a]) * back[a] + (b - a).astype(np.uint64)))
        return first if of is spans else np.arange(len(first)), out[0], out[1]

    return cut


class _Cut:
    """Made anew in each worker, with its own memory of word hashes."""

    def __init__(self, of=spans):
        self.of, self.own = of, None

    def __call__(self, text):
        if self.own is None:
            self.own = cutter(self.of)
        return self.own(text)

    def __reduce__(self):
        return (_Cut, (self.of,))


def cut_out(text: str, marks: list[int]) -> tuple[str, int, str]:
    starts, words = sentences(text)
    first, end = spans(np.array([len(w) for w in words], np.int64))
    until = dict(zip(first.tolist(), end.tolist(), strict=True))
    return _without(text, starts, [(i, until[i]) for i in marks])


def cut_out_runs(text: str, marks: list[int]) -> tuple[str, int, str]:
    starts, words = sentences(text)
    first, end = runs(np.array([len(w) for w in words], np.int64))
    return _without(text, starts, [(int(first[i]), int(end[i])) for i in marks])


def _without(text: str, starts: list[int], repeated: list[tuple[int, int]]) -> tuple[str, int, str]:
    gone = np.zeros(len(starts) - 1, bool)
    for a, b in repeated:
        gone[a:b] = True
    kept, where, at = [], [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
    for a, b in edges.tolist():
        kept.append(text[at : starts[a]])
        at = starts[b]
        where.append(f"{starts[a]}:{at}")
    kept.append(text[at:])
    return "".join(kept), int(gone.sum()), ",".join(where)


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, texts without repeated spans, n_removed (sentences) and removed (start:end, code points)."""
    return _removed(docs, spans, cut_out)


def dedup_runs(docs: DataFrame) -> DataFrame:
    """The same with the spans of ``runs``: repeated runs of sentences go up to their last."""
    return _removed(docs, runs, cut_out_runs)


def _removed(docs: DataFrame, of, out) -> DataFrame:
    own = repeats.keyed(docs)
    rest = repeats.placed(repeats.units(own, _Cut(of))).where(repeats.LATER)
    return repeats.rebuilt(repeats.with_marks(own, repeats.by_document(rest)), out, docs.columns)
