"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words;
a document's score is the noisy-or of its sentences' scores. Only document
labels are known in training; the sentence scores that come out of it point to
the offending sentences.

Defined results: a null or empty text is one empty sentence and gets the
model's base score; repeated rows and ids give one row each; a null ``doc_id``
stays null and isn't held out; without labels every score is 0; an empty table
gives no rows; only ``doc_id`` and ``text`` are read of the documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, give_back, map_arrow, sampled, texts

TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
ALNUM = re.compile(r"[^\W_]+")
#: A sentence with a word.
FILLED = re.compile(r"[^\W_][^.!?\n]*")
ENDS = frozenset(".!?\n")
#: A document or sentence of this score or more counts as toxic.
THRESHOLD = 0.3


@dataclass
class Model:
    bias: float = -40.0
    weights: dict[str, float] = field(default_factory=dict)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def parts(word: str) -> tuple[str, ...]:
    """A word's features: itself and its first four and five letters, marked by a hyphen."""
    n = len(word)
    return (word, word[:4] + "-", word[:5] + "-") if n > 5 else (word, word[:4] + "-") if n > 4 else (word,)


def bags(text: str) -> list[set[str]]:
    """The features of each sentence that has a word."""
    out: list[set[str]] = [set()]
    for t in TOKEN.findall(text.lower()):
        if t in ENDS:
            if out[-1]:
                out.append(set())
        else:
            out[-1].update(parts(t))
    if not out[-1] and len(out) > 1:
        out.pop()
    return out


def train(docs: list[tuple[str, int]], steps: int = 500, l1: float = 1e-4, min_docs: int = 4, most: int = 4000, start: float = -6.0) -> Model:
    """Full-batch proximal Adam on the likelihood of the document labels.

    Features are those met in ``min_docs`` documents or more whose share of
    toxic documents stands out most: ``most`` at most, four standard errors at least.
    """
    y = np.array([v for _, v in docs], float)
    if not len(y) or len(set(y)) < 2:
        return Model()
    # texts are split twice, since the features of all of them would take more memory than the texts by far
    met: dict[str, list[int]] = {}
    for text, label in docs:
        for w in set().union(*bags(text)):
            c = met.setdefault(w, [0, 0])
            c[0] += 1
            c[1] += label == 1
    rate = y.mean()
    stand = {w: (k - c * rate) / np.sqrt(c * rate * (1 - rate)) for w, (c, k) in met.items() if c >= min_docs}
    words = sorted((w for w, z in stand.items() if z >= 4), key=lambda w: (-stand[w], w))[:most]
    vocab = {w: i for i, w in enumerate(words)}
    word, sent, owner = [], [], []
    del met, stand
    for d, (text, _) in enumerate(docs):
        for s in bags(text):
            own = sorted(vocab[w] for w in s if w in vocab)
            word.extend(own)
            sent.extend([len(owner)] * len(own))
            owner.append(d)
    word, sent, owner = np.array(word, np.int32), np.array(sent, np.int32), np.array(owner, np.int32)
    n, v = len(docs), len(vocab)
    w = np.zeros(v + 1)
    w[v] = start
    m1, m2 = np.zeros(v + 1), np.zeros(v + 1)
    for step in range(1, steps + 1):
        z = w[v] + np.bincount(sent, weights=w[word], minlength=len(owner))
        total = np.bincount(owner, weights=np.logaddexp(0, z), minlength=n)
        toward = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-4, 50)), 1.0) / n
        g = toward[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, weights=g[sent], minlength=v) + l1 * np.sign(w[:v]), g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    return Model(float(w[v]), {words[i]: float(w[i]) for i in np.flatnonzero(np.abs(w[:v]) > 0.05)})


class Scorer:
    """Scores texts: one pass of an automaton finds where a known feature may begin."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, None
        if model.weights:
            self.automaton = ahocorasick.Automaton()
            for f in model.weights:
                stem = f.rstrip("-")
                self.automaton.add_word(stem, len(stem))
            self.automaton.make_automaton()

    def hits(self, lower: str) -> list[tuple[int, tuple[str, ...]]]:
        """Where words with known features start, and those features."""
        out, last = [], -1
        for end, n in self.automaton.iter(lower) if self.automaton else ():
            at = end - n + 1
            if at > last and (at == 0 or not ALNUM.match(lower, at - 1)):
                last = at
                if own := tuple(f for f in parts(ALNUM.match(lower, at)[0]) if f in self.model.weights):
                    out.append((at, own))
        return sorted(out)

    def score(self, text: str) -> tuple[float, dict[int, float]]:
        """The document's score, and the logits of those of its sentences that have a known feature."""
        lower, bias = text.lower(), self.model.bias
        found = self.hits(lower)
        count, k, logits = 0, 0, {}
        for m in FILLED.finditer(lower):
            if found and k < len(found) and found[k][0] < m.end():
                own: set[str] = set()
                while k < len(found) and found[k][0] < m.end():
                    own.update(found[k][1])
                    k += 1
                logits[count] = bias + sum(self.model.weights[f] for f in sorted(own))
            count += 1
        total = max(1, count) * float(np.logaddexp(0, bias)) + sum(float(np.logaddexp(0, z) - np.logaddexp(0, bias)) for z in logits.values())
        return 1.0 - float(np.exp(-total)), logits


def offending(model: Model, text: str, logits: dict[int, float]) -> str:
    """start:end of each sentence whose own score reaches the threshold (code points)."""
    bad = {s for s, z in logits.items() if 1 / (1 + np.exp(-z)) >= THRESHOLD}
    if not bad:
        return ""
    out, sentence = [], 0
    for m in SENTENCE.finditer(text):
        if any(t not in ENDS for t in TOKEN.findall(m[0])):
            if sentence in bad:
                out.append(f"{m.start()}:{m.end()}")
            sentence += 1
    return ",".join(out)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_chars: int = 20_000) -> Model:
    """Train on at most ``sample_rows`` labelled rows that aren't held out, chosen by a hash of the id.

    Training alone passes over texts of more than ``sample_chars`` characters,
    so that its size is bounded; scoring takes every text whole.
    """
    own = labels.select("doc_id", column(labels, "toxic", "int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = sampled(own, sample_rows, "doc_id")
    rows = docs.select("doc_id", "text").where(F.length("text") <= sample_chars).join(F.broadcast(own), "doc_id").orderBy("doc_id", F.xxhash64("text"), "text").select("text", "toxic").limit(2 * sample_rows).collect()
    model = train(sorted((r.text, r.toxic) for r in rows))
    del rows
    give_back()
    return model


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, sentences: the offending ones as start:end."""

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            scores, where = [], []
            for t in texts(b["text"]):
                s, logits = scorer.score(t)
                scores.append(s)
                where.append(offending(model, t, logits))
            s = np.array(scores, float)
            yield pa.record_batch([b["doc_id"], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(where, pa.string())], names=["doc_id", "score", "predicted", "sentences"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, run, "doc_id long, score double, predicted int, sentences string")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays under the threshold, with all their columns."""
    names = docs.columns
    schema = docs.schema
    at = names.index("text")

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            ok = [scorer.score(t)[0] < THRESHOLD for t in texts(b.column(at))]
            yield b.filter(pa.array(ok, pa.bool_()))

    return map_arrow(docs, run, schema)
