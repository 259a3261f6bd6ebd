"""Quality rules with an isolation forest over their statistics.

Each document's rule statistics (lengths, symbols, repeated lines and word
windows) are exact counts over its whole text. Fixed rules reject first; what
passes is scored by an isolation forest, whose threshold comes from labelled
rows.

Defined results: a null or empty text has no words and fails the fixed rules;
repeated rows and repeated ids each give their own row; a null ``doc_id`` stays
null; without usable labels the forest keeps everything the rules pass; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit, bitmap, column, discard, map_arrow, marked, mix, texts, words_of, written

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
WINDOW = 8
#: Steps of scores, within each of which thresholds are summed in one task.
STEPS = 1 << 14
FEATURES = ("log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "words_per_line")


def repeated_words(words: list[str], k: int = WINDOW) -> int:
    """Positions covered by a ``k``-word window that occurs twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(grams)) == n:
        return 0
    seen: dict[tuple[str, ...], int] = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered, reach = 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + k - max(i, reach)
            reach = i + k
    return covered


def statistics(text: str) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distinct words, lines with a word."""
    words = words_of(text)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words), len(set(words)), lines)


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat > 30 * n_words)


def features(stats: np.ndarray) -> np.ndarray:
    n, chars, symbols, dup, repeat, distinct, lines = stats.T.astype(np.float64)
    some = np.maximum(n, 1)
    return np.stack([np.log1p(n), np.log1p(chars / some), np.log1p(20 * symbols / some), dup / np.maximum(lines, 1), np.log1p(10 * repeat / some), np.log1p(distinct) - np.log1p(n), np.log1p(n / np.maximum(lines, 1))], axis=1)


@dataclass
class Forest:
    """Trees in flat arrays, one row a tree; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    levels: int
    usual: float

    @staticmethod
    def path(n: float) -> float:
        """Mean depth at which ``n`` rows are told apart."""
        return 0.0 if n <= 1 else 1.0 if n <= 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray, box: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 7, own: list[np.ndarray] | None = None) -> Forest:
        """Grow trees over ``x``; splits are drawn from ``box``, its rows the least and greatest values.

        A box wider than ``x`` leaves empty leaves near the root: what falls
        into one is unlike every row of ``x`` and has a short path. ``own``: each
        tree's rows, where they are drawn already.
        """
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        levels = max(1, int(np.ceil(np.log2(max(rows, 2)))) + 2)
        size = 2 ** (levels + 1)
        f, t, left, right, depth = (np.zeros((trees, size), dtype=d) for d in (np.int32, np.float64, np.int32, np.int32, np.float64))
        for k in range(trees):
            left[k] = right[k] = np.arange(size)
            todo, used = [(0, own[k] if own else rng.choice(len(x), rows, replace=False), 0, box[0], box[1])], 1
            while todo:
                node, at, level, low, high = todo.pop()
                part = x[at]
                open_ = np.flatnonzero(high > low)
                if level == levels or len(at) <= 1 or not len(open_):
                    depth[k, node] = level + cls.path(len(at))
                    continue
                f[k, node] = rng.choice(open_)
                t[k, node] = rng.uniform(low[f[k, node]], high[f[k, node]])
                goes = part[:, f[k, node]] > t[k, node]
                left[k, node], right[k, node] = used, used + 1
                below, above = high.copy(), low.copy()
                below[f[k, node]] = above[f[k, node]] = t[k, node]
                todo += [(used, at[~goes], level + 1, low, below), (used + 1, at[goes], level + 1, above, high)]
                used += 2
        return cls(f, t, left, right, depth, levels, cls.path(rows) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; near 1: told apart after few splits."""
        out = np.zeros(len(x))
        tree = np.arange(len(self.feature))[None, :]
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            node = np.zeros((len(part), len(self.feature)), dtype=np.int32)
            at = np.arange(len(part))[:, None]
            for _ in range(self.levels):
                goes = part[at, self.feature[tree, node]] > self.threshold[tree, node]
                node = np.where(goes, self.right[tree, node], self.left[tree, node])
            out[lo : lo + 1024] = 2.0 ** (-self.depth[tree, node].mean(1) / self.usual)
        return out


@dataclass
class Model:
    forest: Forest | None
    threshold: float


def calibrate(counts: DataFrame, max_false: float = 0.01) -> float:
    """The threshold with the best detected-minus-wrongly-rejected share, rejecting at most ``max_false`` of good rows.

    ``counts`` has the distinct scores (0 to 1) with their numbers of ``good`` and ``bad`` rows.
    Scores are dealt into ``STEPS`` steps, whose sums go to the driver; within a step they are summed by score.
    """
    step = F.floor(F.col("score") * STEPS).alias("step")
    sums = counts.groupBy(step).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy(F.desc("step")).collect()
    n_good, n_bad = sum(r.good for r in sums), sum(r.bad for r in sums)
    if not n_good or not n_bad:
        return 2.0
    above, good, bad = [], 0, 0
    for r in sums:
        above.append((r.step, good, bad))
        good, bad = good + r.good, bad + r.bad
    before = counts.sparkSession.createDataFrame(above, "step long, above_good long, above_bad long")
    down = Window.partitionBy("step").orderBy(F.desc("score"))
    gone = counts.withColumn("step", step).join(F.broadcast(before), "step")  # a row a step
    gone = gone.select("score", (F.sum("good").over(down) + F.col("above_good")).alias("wrong"), (F.sum("bad").over(down) + F.col("above_bad")).alias("right"))
    gain = F.col("right").cast("decimal(38,0)") * n_good - F.col("wrong").cast("decimal(38,0)") * n_bad
    best = gone.where(F.col("wrong") / n_good <= max_false).agg(F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("low"))).alias("best")).first().best
    return -best.low if best and best.gain > 0 else 2.0


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, good, x: features of every labelled row that the fixed rules pass; the worse label of an id counts."""
    worst = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, "quality", "int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(worst.select("doc_id")))

    def run(batches):
        wanted = np.frombuffer(bits.value, np.uint64)
        for b in batches:
            b = b.filter(pa.array(marked(wanted, b["at"].to_numpy())))
            stats = np.array([statistics(t) for t in texts(b["text"])], dtype=np.int64).reshape(-1, 7)
            passed = ~base_failed(stats[:, 0], stats[:, 4])
            x = pa.array(list(features(stats[passed])), pa.list_(pa.float64()))
            b = b.filter(pa.array(passed))
            yield pa.record_batch([b["doc_id"], b["key"], x], names=["doc_id", "key", "x"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    own = docs.select(doc_id.alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL").withColumns({"key": F.xxhash64("doc_id", "text"), "at": bit(F.col("doc_id"))})
    return map_arrow(own, run, "doc_id long, key long, x array<double>").join(worst, "doc_id").select("key", (F.col("quality") == 1).alias("good"), "x")


def _of_trees(rows: DataFrame, n: int, trees: int, size: int) -> list[np.ndarray]:
    """``size`` of the ``n`` good rows for each tree, those with the least hashes of the tree's own."""
    share = min(1.0, (size + 10 * np.sqrt(size)) / n)

    def run(batches):
        for b in batches:
            key, x = b["key"].to_numpy().view(np.uint64), b["x"]
            for k in range(trees):
                h = mix(key ^ mix(np.full(len(key), k + 1, np.uint64)))
                near = np.flatnonzero(h >> np.uint64(11) < share * 2.0**53)
                if len(near):
                    yield pa.record_batch([pa.array(np.full(len(near), k, np.int32)), pa.array(h[near].view(np.int64)), x.take(pa.array(near))], names=["tree", "h", "x"])

    found = map_arrow(rows.where("good").select("key", "x"), run, "tree int, h long, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    tree, h = found["tree"].to_numpy(), found["h"].to_numpy().view(np.uint64)
    order = np.lexsort((*x.T, h, tree))  # the order of arrival doesn't matter
    x, tree = x[order], tree[order]
    return [x[tree == k][:size] for k in range(trees)]


def fit(docs: DataFrame, labels: DataFrame, trees: int = 100, rows: int = 256) -> Model:
    """Fit on all labelled rows: the forest's ``rows`` a tree are drawn from all good ones, box and threshold come from all."""
    own = written(_labelled(docs, labels), "quality")
    ends = [f(F.col("x")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(len(FEATURES))]
    sums = own.agg(F.count_if("good").alias("good"), *ends).first()
    if sums.good < 16:
        discard(own)
        return Model(None, 2.0)
    box = np.array([[sums[f"{name}{k}"] for k in range(len(FEATURES))] for name in ("low", "high")])
    parts = _of_trees(own, sums.good, trees, min(rows, sums.good))
    forest = Forest.fit(np.concatenate(parts), box, trees, min(rows, sums.good), own=np.split(np.arange(sum(map(len, parts))), np.cumsum([len(p) for p in parts])[:-1]))

    def run(batches):
        for b in batches:
            x = np.array(b["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
            yield pa.record_batch([pa.array(forest.score(x)), b["good"]], names=["score", "good"])

    scores = map_arrow(own.select("x", "good"), run, "score double, good boolean")
    counts = written(scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "scores")
    threshold = calibrate(counts)
    discard(own, counts)
    return Model(forest, threshold)


def apply(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for b in batches:
            stats = np.array([statistics(t) for t in texts(b["text"])], dtype=np.int64).reshape(-1, 7)
            failed = base_failed(stats[:, 0], stats[:, 4])
            score = model.forest.score(features(stats)) if model.forest else np.zeros(len(stats))
            kept = ~failed & (score < model.threshold)
            yield pa.record_batch([b["doc_id"], *(pa.array(stats[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double")
