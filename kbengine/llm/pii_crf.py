"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The patterns give the base spans. Tokens that hold a digit or an @ are the
variables of the field; its labels are the four kinds, secrets, and none.
Neighbours in the text share chain potentials. Tokens share skip potentials
where they repeat or are similar (same last seven digits, same local part of an
address, or one character apart): each with the last such token before it that
is labelled, or else the first after it, so that evidence is one skip
away however long the document is; where none is labelled, each with
its last occurrence before. Tokens between the same two words share a weaker
potential with the last such token. Loopy sum-product passing until messages converge
makes labels agree over the document: a number that stands once in a form the
patterns know is found in its other forms too.

Weights come from a bounded sample of documents, labelled by the base spans and,
for secrets, by what is assigned to a name such as ``token`` or ``password``. Every
labelled token is learned from twice, once without the features that the patterns
and assignments test (a plus, a checksum, the name before), so that other forms
of the same data have positives.

Defined results: null and empty texts have no spans; repeated rows and ids each
give a row; base spans always stay, added ones never overlap them; an empty
table gives no rows, and without tokens to learn from nothing is added; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sampled, texts

# Fixed patterns. They match from the leftmost possible place; possessive repeats keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SOME = re.compile(r"[0-9@]")
#: What is assigned to a name that says it is secret: a label, no base span.
SECRET = re.compile(r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd|bearer)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([A-Za-z0-9+/_=.-]{16,512})")
SECRET_KIND = len(KINDS)
LABELS = len(KINDS) + 2

O = 0  # noqa: E741
#: A token that may be personal data, with what stands around it in the same word.
TOKEN = re.compile(r"\S+")
EDGE = ".,;:!?\"'<>[]{}|"
#: How sure the field must be of a token that shares a skip potential with a labelled one, and of any other.
SURE, ALONE = 0.9, 0.98
#: Words before tokens that are features of their own, at most.
CONTEXTS = 64
#: Messages are passed until none changes by more, or for so many rounds where they circle.
SETTLED = 1e-3
ROUNDS = 200
#: Tokens further apart than so many characters share no chain potential.
NEAR = 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = []
    if "@" in text:
        low = 0
        for m in DOMAIN.finditer(text):
            at = start = m.start()
            while start > low and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                low = m.end()
    if not SOME.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the words with an ASCII digit or an @, without punctuation at their edges."""
    out = []
    for m in TOKEN.finditer(text):
        word = m[0]
        if not SOME.search(word):
            continue
        left = len(word) - len(word.lstrip(EDGE))
        right = len(word.rstrip(EDGE))
        if right > left:
            out.append((m.start() + left, m.start() + right))
    return out


SHAPES = 27
#: Features that the patterns and assignments test: a plus, a checksum, the domain of an address, a name with = or : before.
TESTED = (1, 5, 23, 24)
BEFORE = re.compile(r"([^\W\d_]+)\W*$")
AFTER = re.compile(r"\W*([^\W\d_]+)")


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a token, lower-cased."""
    a, b = BEFORE.search(text[max(0, start - 40) : start]), AFTER.match(text[end : end + 40])
    return a[1].lower() if a else "", b[1].lower() if b else ""


def features(text: str, start: int, end: int) -> np.ndarray:
    """Shape of a token: what it is made of, its length, what stands before and after it."""
    w = text[start:end]
    digits = sum(c in "0123456789" for c in w)
    letters = sum(c.isalpha() for c in w)
    before, after = text[max(0, start - 2) : start].strip(), text[end : end + 2].strip()
    x = np.zeros(SHAPES)
    x[0] = 1
    x[1] = "@" in w and "." in w.rpartition("@")[2]
    x[2] = "@" in w
    x[3] = w.count(".") == 3 and digits == len(w) - 3
    x[4] = w.count(".") > 0
    x[5] = w[:1] == "+"
    x[6] = "(" in w or ")" in w
    x[7] = "-" in w
    x[8] = digits == len(w)
    x[9 + min(digits, 4)] = digits <= 4
    x[14] = 5 <= digits <= 6
    x[15] = 7 <= digits <= 8
    x[16] = 9 <= digits <= 11
    x[17] = 12 <= digits <= 19
    x[18] = digits > 19
    x[19] = digits / len(w)
    x[20] = letters > 0
    x[21] = before[-1:].isdigit() or before[-1:] == ")"
    x[22] = after[:1].isdigit() or after[:1] == "("
    x[23] = 12 <= digits <= 19 and digits == len(w) and luhn(w)
    x[24] = before[-1:] in ("=", ":") or text[max(0, start - 4) : start].strip("\"' \t")[-1:] in ("=", ":")
    x[25] = len(w) >= 20 and digits >= 4 and letters >= 4
    x[26] = "://" in w or "/" in w
    return x


def skip_key(word: str) -> str:
    """Equal for repeated and similar tokens; empty: none is similar."""
    if "@" in word:
        return "@" + word.partition("@")[0].lower().lstrip("(<\"'")
    digits = "".join(c for c in word if c in "0123456789")
    return digits[-7:] if len(digits) >= 7 else ""


def halves(word: str) -> list[tuple[int, str]]:
    """Of two longer tokens that differ in one character, one half is the same."""
    own = "".join(c for c in word.lower() if c.isalnum())
    if not 10 <= len(own) <= 64:
        return []
    return [(0, own[: len(own) // 2]), (1, own[len(own) - len(own) // 2 :])]


def one_apart(a: str, b: str) -> bool:
    """Whether two tokens differ in one character, left out, put in or changed, besides case and punctuation."""
    a, b = ("".join(c for c in x.lower() if c.isalnum()) for x in (a, b))
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


@dataclass
class Graph:
    """The variables of some documents: texts' tokens, their features, and the edges."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    x: np.ndarray
    label: np.ndarray
    #: Whether the label comes from a base span.
    base: np.ndarray
    before: list[str]
    chain: np.ndarray
    skip: np.ndarray
    place: np.ndarray


def skips(own: list[int], label: list[int]) -> list[tuple[int, int]]:
    """Pairs of similar tokens, given in order, that share a skip potential."""
    known = next((n for n in own if label[n]), None)
    if known is None:
        return list(zip(own, own[1:]))
    out, hub = [], None
    for n in own:
        if hub is not None:
            out.append((hub, n))
        elif n != known:
            out.append((n, known))
        if label[n]:
            hub = n
    return out


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what is assigned as a secret and holds a digit."""
    return [(m.start(1), SECRET_KIND, m.end(1)) for m in SECRET.finditer(text) if re.search("[0-9]", m[1])]


def covering(spans: list[tuple[int, int, int]], words: list[tuple[int, int]]) -> list[int]:
    """For each token the label of the first span that overlaps it; both are in order of their start."""
    out, k = [], 0
    for s, e in words:
        while k < len(spans) and spans[k][2] <= s:
            k += 1
        j, hit = k, O
        while j < len(spans) and spans[j][0] < e:
            if spans[j][2] > s:
                hit = spans[j][1] + 1
                break
            j += 1
        out.append(hit)
    return out


def graph(batch: list[str], base: list[list[tuple[int, int, int]]]) -> Graph:
    owner, start, end, xs, label, fixed, before, chain, skip, place = [], [], [], [], [], [], [], [], [], []
    for d, text in enumerate(batch):
        if not SOME.search(text):
            continue
        alike: dict[str, list[int]] = {}
        half: dict[tuple[int, str], int] = {}
        between: dict[tuple[str, str], int] = {}
        prior = None
        words = tokens(text)
        of_base, of_secret = covering(base[d], words), covering(secrets(text), words)
        for (s, e), hit, more in zip(words, of_base, of_secret, strict=True):
            n = len(start)
            owner.append(d)
            start.append(s)
            end.append(e)
            xs.append(features(text, s, e))
            label.append(hit or more)
            fixed.append(hit > 0)
            sides = around(text, s, e)
            before.append(sides[0])
            if prior is not None and s - end[prior] <= NEAR:
                chain.append((prior, n))
            word = text[s:e]
            if key := skip_key(word):
                alike.setdefault(key, []).append(n)
            elif len(word) >= 16:
                alike.setdefault(word, []).append(n)
            for h in halves(word):
                if (m := half.get(h)) is not None and text[start[m] : end[m]] != word and one_apart(text[start[m] : end[m]], word):
                    skip.append((m, n))
                half[h] = n
            if all(len(x) > 2 for x in sides):
                if (m := between.get(sides)) is not None:
                    place.append((m, n))
                between[sides] = n
            prior = n
        for own in alike.values():
            skip += skips(own, label)
    edges = lambda e: np.array(sorted(set(e)), np.int64).reshape(-1, 2)
    return Graph(
        np.array(owner, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(xs).reshape(-1, SHAPES), np.array(label, np.int64), np.array(fixed, bool),
        before, edges(chain), edges(skip), edges(place),
    )


@dataclass
class Model:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    place: np.ndarray
    #: The words before a token that are features, each with its number.
    words: dict[str, int]

    def inputs(self, g: Graph) -> np.ndarray:
        """The features of shape, then one for each known word before."""
        more = np.zeros((len(g.label), len(self.words)))
        for i, w in enumerate(g.before):
            if (k := self.words.get(w)) is not None:
                more[i, k] = 1
        return np.concatenate([g.x, more], axis=1)


def train(batch: list[str], steps: int = 300) -> Model:
    """Weights by piecewise training: a softmax for the tokens, smoothed counts for the kinds of edges."""
    base = [base_spans(t) for t in batch]
    g = graph(batch, base)
    n = LABELS
    # the potentials of edges are how much more often a pair of labels occurs than by chance
    share = (np.bincount(g.label, minlength=n) + 1.0) / (len(g.label) + n)

    def pairs(edges: np.ndarray, prior: np.ndarray, most: float) -> np.ndarray:
        c = prior.copy()
        np.add.at(c, (g.label[edges[:, 0]], g.label[edges[:, 1]]), 1)
        return np.clip(np.log(c / c.sum()) - np.log(np.outer(share, share)), -most, most)

    chance = np.outer(share, share)
    chain, place = pairs(g.chain, chance * 20, 3.0), pairs(g.place, chance * 20, 1.5)
    # agreement is what skip edges are for: their prior says that similar tokens are of one kind
    skip = pairs(g.skip, np.diag(share) * 100 + chance, 6.0)
    met = Counter(w for w in g.before if w)
    words = sorted((w for w, c in met.items() if c >= 5), key=lambda w: (-met[w], w))[:CONTEXTS]
    model = Model(np.zeros((SHAPES + len(words), n)), chain, skip, place, {w: k for k, w in enumerate(words)})
    if len(g.label):
        x = model.inputs(g)
        some = g.label > 0
        masked = x[some].copy()
        masked[:, TESTED] = 0
        masked[:, SHAPES:] = 0
        x, y = np.concatenate([x, masked]), np.concatenate([g.label, g.label[some]])
        # an even weight for each kind met, so that rare kinds count, and as much for tokens that are none
        counts = np.bincount(y, minlength=n)
        rows = (1 / np.maximum(counts, 1))[y]
        rows[y == 0] *= max(1, (counts[1:] > 0).sum())
        rows /= rows.sum()
        y = np.eye(n)[y]
        w = model.unary
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w -= 3.0 * (x.T @ ((p - y) * rows[:, None]) + 1e-4 * w)
    return model


def marginals(g: Graph, model: Model, clamp: bool = True) -> np.ndarray:
    """Loopy sum-product over all edges at once, damped; tokens in base spans keep their label. Exact where no edges form a loop."""
    unary = model.inputs(g) @ model.unary
    if clamp:
        fixed = g.base
        unary[fixed] = np.where(np.eye(unary.shape[1], dtype=bool)[g.label[fixed]], 0.0, -1e9)  # no number of messages outweighs it
    unary -= unary.max(1, keepdims=True, initial=-np.inf) if len(unary) else 0
    kinds = ((g.chain, model.chain), (g.skip, model.skip), (g.place, model.place))
    a, b = (np.concatenate([e[:, k] for e, _ in kinds]) for k in (0, 1))
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    m = len(a)
    if m:
        # edges in order of the token that they lead to, so that beliefs are sums of runs
        pot = np.exp(np.stack([p for _, p in kinds] + [p.T for _, p in kinds]))
        kind = np.concatenate([np.repeat(np.arange(3), [len(e) for e, _ in kinds])] * 2) + np.repeat([0, 3], m)
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        order = np.argsort(target, kind="stable")
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        source, target, kind, back = source[order], target[order], kind[order], at[back[order]]
        own, first = np.unique(target, return_index=True)
        of_kind = [np.flatnonzero(kind == k) for k in range(6)]
        msg = np.zeros((2 * m, unary.shape[1]))
        for _ in range(ROUNDS):
            belief = unary.copy()
            belief[own] += np.add.reduceat(msg, first)
            out = belief[source] - msg[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(out)
            for k, some in enumerate(of_kind):
                if len(some):
                    new[some] = out[some] @ pot[k]
            new = np.log(np.maximum(new, 1e-30))
            new -= new.max(1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if change <= SETTLED:
                break
        unary[own] += np.add.reduceat(msg, first)
    p = np.exp(unary - unary.max(1, keepdims=True)) if len(unary) else unary
    return p / p.sum(1, keepdims=True)


def added_spans(batch: list[str], base: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds: runs of chained tokens of one kind, none of them in a base span, of each of which the field is sure enough."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    g = graph(batch, base)
    if not len(g.label):
        return out
    p = marginals(g, model)
    best, most = p.argmax(1), p.max(1)
    near = np.zeros(len(best), bool)
    for a, b in ((0, 1), (1, 0)):
        near[g.skip[g.label[g.skip[:, a]] > 0, b]] = True
    sure = (best > 0) & ~g.base & (most >= np.where(near, SURE, ALONE))
    for i in np.flatnonzero(sure).tolist():
        own, kind = out[g.owner[i]], int(best[i]) - 1
        start, end = int(g.start[i]), int(g.end[i])
        if own and sure[i - 1] and own[-1][1] == kind and start - own[-1][2] <= NEAR:
            own[-1] = (own[-1][0], kind, end)
        else:
            own.append((start, kind, end))
    return out


def bounded(batch: list[str], chars: int = 500_000) -> list[tuple[int, int]]:
    """Runs of texts that share a graph: as many as hold ``chars`` characters, one at least."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(batch):
        if i > lo and size + len(t) > chars:
            out.append((lo, i))
            lo, size = i, 0
        size += len(t)
    return [*out, (lo, len(batch))] if batch else out


#: How a span's kind is written.
NAMES = (*KINDS, "secret")


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in sorted(spans))


def fit(docs: DataFrame, sample_rows: int = 2000, sample_chars: int = 20_000) -> Model:
    """Train on at most ``sample_rows`` texts with a digit or an @, of at most ``sample_chars`` characters, chosen by a hash of the id."""
    own = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= sample_chars))
    rows = sampled(own, sample_rows, "doc_id", "text").select("text").collect()
    return train(sorted(r.text for r in rows))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans: the four counts and the hash are of the base spans."""

    def run(batches):
        for b in batches:
            own = texts(b["text"])
            base = [base_spans(t) for t in own]
            more = [x for lo, hi in bounded(own) for x in added_spans(own[lo:hi], base[lo:hi], model)]
            counts = np.zeros((len(own), len(KINDS)), np.int64)
            for d, spans in enumerate(base):
                for _, k, _ in spans:
                    counts[d, k] += 1
            sha = [hashlib.sha256(said(s).encode()).hexdigest() for s in base]
            yield pa.record_batch(
                [b["doc_id"], *(pa.array(counts[:, k]) for k in range(4)), pa.array(sha, pa.string()), pa.array([said(x + y) for x, y in zip(base, more, strict=True)], pa.string()), pa.array([len(m) for m in more], pa.int64()), pa.array([len(x) + len(y) for x, y in zip(base, more, strict=True)], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
