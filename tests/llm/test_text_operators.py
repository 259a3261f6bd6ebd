"""Per-document operators against brute force and libraries."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from kbengine.llm import byte_bpe, pii_crf, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.01"


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_statistics(spark, make, clash, corpus):
    model = quality_rules.Model(None, 2.0)
    more = [(1000, "a b c d e f g h i " * 3), (1001, "x\x1cy z q"), (1002, "#*$ | <>\n\n \n#*$ | <>")]
    got = quality_rules.apply(clash(make(corpus + more)), model).collect()
    assert len(got) == len(corpus) + len(more)
    by_id = {i: t for i, t in corpus + more if i is not None}
    for r in got:
        if r.doc_id is not None:
            n, *rest = brute_stats(by_id[r.doc_id] or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
            assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n)
            assert r.kept == (not r.base_failed)


def test_forest_tells_junk_apart(spark):
    docs, labels = (queries.table(spark, SF, n) for n in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    own = {r.doc_id: r for r in quality_rules.apply(docs, model).collect()}
    good = [own[r.doc_id].kept for r in labels.collect() if r.quality == 1]
    bad = [own[r.doc_id].kept for r in labels.collect() if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3


def plain_threshold(score, good):
    gone = [(sum(1 for s, g in zip(score, good, strict=True) if s >= t and g), sum(1 for s, g in zip(score, good, strict=True) if s >= t and not g), t) for t in set(score)]
    n, m = sum(good), len(good) - sum(good)
    best = max((right * n - wrong * m, -t) for wrong, right, t in gone if wrong / n <= 0.01)
    return -best[1] if best[0] > 0 else 2.0


def test_threshold_is_of_all_labelled_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(quality_rules, "STEPS", 8)
    for low in (0.3, 0.9):
        good = rng.random(500) < 0.7
        score = np.round(np.where(good, rng.random(500) * 0.6, low + rng.random(500) * (1 - low)), 2)
        rows = spark.createDataFrame([(float(s), int(g), int(not g)) for s, g in zip(score, good, strict=True)], "score double, good long, bad long")
        got = quality_rules.calibrate(rows.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
        assert got == plain_threshold(score.tolist(), good.tolist())
    # more labelled rows than the 4,000 that were looked at before
    words = ["alpha", "beta", "gamma", "de", "#x", "y|", "longerword"]
    own = [(k, " ".join(rng.choice(words, 20 + k % 90, p=[0.3, 0.3, 0.2, 0.17, 0.01, 0.01, 0.01] if k % 5 else None)), int(k % 5 > 0)) for k in range(4600)]
    frame = spark.createDataFrame(own, "doc_id long, text string, quality int")
    model = quality_rules.fit(frame, frame.select("doc_id", "quality"))
    quality = {k: q == 1 for k, _, q in own}
    passed = [r for r in quality_rules.apply(frame, model).collect() if not r.base_failed]
    assert len(passed) > 4000 and 0 < model.threshold < 1
    assert model.threshold == plain_threshold([r.anomaly for r in passed], [quality[r.doc_id] for r in passed])
    again = quality_rules.fit(frame.repartition(3), frame.select("doc_id", "quality"))
    assert again.threshold == model.threshold and np.array_equal(again.forest.threshold, model.forest.threshold)


def test_no_labels_and_no_rows(spark, make):
    docs = make([(1, "word " * 30 + "and so on")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(docs, none).forest is None
    assert quality_rules.apply(docs.where("false"), quality_rules.fit(docs, none)).count() == 0
    assert toxicity.apply(docs, toxicity.fit(docs, none)).first().score == 0
    assert toxicity.apply(docs.where("false"), toxicity.Model()).count() == 0


@pytest.fixture(scope="module")
def encoding():
    v = queries.vocabulary()
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.parse(), special_tokens={})


def test_bpe_equals_the_library(spark, make, clash, corpus, encoding):
    v, enc = encoding
    rng = random.Random(1)
    odd = [" ", "  a  b \n\n c\n", "a\x1c.b \x1f!", "x　y z", "don't  we'll", "a" * 3000, "日本語 中文", "😀😀 👍🏽", "\x85 a\x85b", "١٢٣ ½"]
    odd += ["".join(rng.choices(list(" \n\t\r\x85\xa0ab.'sA1é !"), k=rng.randint(1, 40))) for _ in range(300)]
    rows = corpus + [(2000 + i, t) for i, t in enumerate(odd)]
    texts = {i: t or "" for i, t in rows if i is not None}
    got = byte_bpe.digest(clash(make(rows)), v).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(make(rows), v), v)
    assert {r.doc_id: r.text for r in back.collect() if r.doc_id is not None} == texts


def test_memory_of_words_may_be_emptied(encoding, monkeypatch):
    v, enc = encoding
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 5)
    c = byte_bpe.Codec(v)
    for t in ("one two three four five six", "seven eight one two", "nine, ten: one"):
        ids, ends = c.encode(pa.array([t]))
        assert ids.tolist() == enc.encode_ordinary(t) and c.decode(ids, ends)[0].tobytes() == t.encode()


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else False, 12 <= len(d) <= 19 and pii_crf.luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choices("01 59-.@+a_()é%444", k=rng.randint(0, 60)))
        assert pii_crf.base_spans(t) == brute_spans(t)
    pii_crf.base_spans("9" * 200_000 + " " + "a" * 200_000 + "@")  # linear
    pii_crf.tokens("a" * 200_000)


def test_skip_chain_adds_repeated_forms(spark, make, clash):
    rng = random.Random(2)
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    some = [(i, f"and so +1 ({num(3)}) 555-{num(4)} it is a{num(2)}.b@mail.example.com in {rng.randint(1, 250)}.{rng.randint(1, 250)}.3.4 of year {num(4)} or {num(2)}") for i in range(200)]
    text = "Call +1 (456) 555-2186 now. Later 555-2186 again; in 1999 and 12."
    rows = [*some, (500, text), (501, None), (502, ""), (503, text)]
    docs = make(rows)
    got = {r.doc_id: r for r in pii_crf.find(clash(docs), pii_crf.fit(docs)).collect()}
    assert len(got) == len(rows)
    at = text.index("555-2186 again")
    assert f"phone:{at}:{at + 8}" in got[500].spans.split(",") and got[500].n_added == 1
    assert (got[501].spans, got[501].base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    for i, t in some:
        said = ",".join(f"{pii_crf.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))


def tree_of(rng, n):
    """A small field without loops: the tokens, and chain, skip and place edges among them."""
    edges = [(int(rng.integers(0, k)), k) for k in range(1, n)]
    kind = rng.integers(0, 3, len(edges))
    own = [np.array([e for e, k in zip(edges, kind) if k == j], np.int64).reshape(-1, 2) for j in range(3)]
    label = np.where(rng.random(n) < 0.3, rng.integers(1, 5, n), 0)
    return pii_crf.Graph(np.zeros(n, np.int64), np.arange(n), np.arange(n) + 1, rng.normal(size=(n, pii_crf.SHAPES)), label, label > 0, [""] * n, *own)


@pytest.mark.parametrize("seed", range(4))
def test_marginals_equal_exact_ones_on_trees(seed):
    rng = np.random.default_rng(seed)
    g, k = tree_of(rng, 5), pii_crf.LABELS
    m = pii_crf.Model(rng.normal(size=(pii_crf.SHAPES, k)) * 0.3, rng.normal(size=(k, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)), {})
    unary = g.x @ m.unary
    total = np.zeros((5, k))
    for labels in np.ndindex(*[k] * 5):
        if any(b and x != y for b, x, y in zip(g.base, labels, g.label)):
            continue
        z = sum(unary[i, x] for i, x in enumerate(labels))
        z += sum(p[labels[a], labels[b]] for e, p in ((g.chain, m.chain), (g.skip, m.skip), (g.place, m.place)) for a, b in e)
        for i, x in enumerate(labels):
            total[i, x] += np.exp(z)
    assert np.allclose(pii_crf.marginals(g, m), total / total.sum(1, keepdims=True), atol=5e-3)


def test_masked_base_spans_are_found():
    """Trained on some documents, the field finds the base spans of others without being told them."""
    rng = random.Random(8)
    num = lambda n: "".join(rng.choices("0123456789", k=n))

    def card(ok):
        while True:
            c = num(16)
            if pii_crf.luhn(c) == ok:
                return c

    forms = [lambda: f"+1 ({num(3)}) 555-{num(4)}", lambda: f"a{num(2)}.b@mail.example.com", lambda: f"{rng.randint(1, 250)}.{rng.randint(1, 250)}.3.4", lambda: card(True), lambda: card(False), lambda: num(4), lambda: f"{num(1)}.{num(1)}", lambda: 'token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"']
    word = lambda: "".join(rng.choices("aeilnorst", k=rng.randint(3, 7)))
    docs = [" ".join([word(), word(), rng.choice(forms)(), word(), word(), rng.choice(forms)(), word()]) for _ in range(900)]
    model = pii_crf.train(docs[:600])
    base = [pii_crf.base_spans(t) for t in docs[600:]]
    g = pii_crf.graph(docs[600:], base)
    p = pii_crf.marginals(g, model, clamp=False)
    best, sure = p.argmax(1), p.max(1) >= pii_crf.SURE
    for kind in range(1, pii_crf.LABELS):
        own = g.label == kind
        assert own.sum() >= 20 and ((best == kind) & sure)[own].mean() >= 0.9
    assert ((best > 0) & sure & (g.label == 0)).sum() <= 0.02 * (g.label == 0).sum()


def test_field_on_long_and_empty_input(spark, make):
    rng = random.Random(4)
    model = pii_crf.train([])
    assert pii_crf.find(make([]).where("false"), pii_crf.fit(make([]).where("false"))).count() == 0
    assert pii_crf.find(make([(1, "call 12 now")]), model).first().n_added == 0
    text = " ".join(rng.choice(["call 555-%04d now", "mail a%d.b@mail.example.com it", "in %d it"]) % rng.randint(0, 9999) for _ in range(60_000))
    began = time.process_time()
    words = pii_crf.tokens(text)
    pii_crf.covering(pii_crf.base_spans(text), words)
    assert len(words) > 50_000 and time.process_time() - began < 10
    assert pii_crf.one_apart("ab-12", "AB123") and pii_crf.one_apart("abc", "abd") and not pii_crf.one_apart("abc", "acb")


def test_words_of_any_length(encoding):
    v, enc = encoding
    c, rng = byte_bpe.Codec(v), random.Random(5)
    own = ["".join(rng.choices(a, k=n)) for a in ("abcdefgh", "ab", "etaoinshr", "é日") for n in (63, 64, 65, 400, 401, 2000)] + ["ab" * 900, "aab" * 700, "the" * 800, "." * 5000, "a" * 10_001]
    ids, ends = c.encode(pa.array(own))
    for t, x in zip(own, np.split(ids, ends[:-1])):
        assert x.tolist() == enc.encode_ordinary(t)
    back, last = c.decode(ids, ends)
    assert [x.tobytes().decode() for x in np.split(back, last[:-1])] == own
    with pytest.raises(ValueError):
        c.decode(np.array([10**6]), np.array([1]))


def noisy_or(model, text):
    """By the definition: one minus the product of the sentences' chances to be clean."""
    out = 1.0
    for own in re.split(r"[.!?\n]", text.lower()):
        words = re.findall(r"[^\W_]+", own)
        if words:
            feats = {f for w in words for f in ([w] + ([w[:4] + "-"] if len(w) > 4 else []) + ([w[:5] + "-"] if len(w) > 5 else []))}
            out *= 1 - 1 / (1 + np.exp(-model.bias - sum(model.weights.get(f, 0) for f in feats)))
    return 1 - out if re.search(r"[^\W_]", text) else 1 / (1 + np.exp(-model.bias))


def test_scores_equal_a_plain_noisy_or(corpus):
    rng = random.Random(3)
    model = toxicity.Model(-5.0, {w: rng.uniform(-2, 5) for w in ("that", "thing", "ered", "erat-", "ndly", "nding-", "one", "heat", "x", "onble")})
    scorer = toxicity.Scorer(model)
    for t in [t or "" for _, t in corpus] + ["One two. that! Nding thing\n\n...", "x_that that", "long " * 100_000 + "thing"]:
        assert abs(scorer.score(t)[0] - noisy_or(model, t)) < 1e-9


def plain_score(forest, x):
    """By the definition: the mean over trees of the path length at which a row falls out."""
    lengths = []
    for k in range(len(forest.feature)):
        node = 0
        while forest.left[k, node] != node:
            node = forest.right[k, node] if x[forest.feature[k, node]] > forest.threshold[k, node] else forest.left[k, node]
        lengths.append(forest.depth[k, node])
    return 2 ** (-np.mean(lengths) / forest.usual)


def test_forest_equals_a_plain_walk_and_finds_outliers():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    far = rng.normal(size=(20, 4)) + 8
    forest = quality_rules.Forest.fit(x, np.stack([np.full(4, -12.0), np.full(4, 12.0)]), 50)
    both = np.concatenate([x[:50], far])
    got = forest.score(both)
    assert np.allclose(got, [plain_score(forest, r) for r in both])
    assert got[50:].min() > np.quantile(got[:50], 0.95)


def test_toxicity_on_rows_held_out(spark):
    docs, labels = (queries.table(spark, SF, n) for n in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op8_toxicity_mil(spark, SF).collect()}
    assert len(got) == docs.count()
    own = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p for y, p in own if y == 0]) < 0.1
    assert np.mean([p for y, p in own if y == 1]) > 0.6


def test_offending_sentences():
    m = toxicity.Model(-8.0, {"vile": 10.0})
    text = "All is well. You vile thing! Bye\nno viler word"
    s, logits = toxicity.Scorer(m).score(text)
    assert s > 0.5 and toxicity.offending(m, text, logits) == f"{text.index(' You')}:{text.index(' Bye')}"
    assert toxicity.Scorer(m).score("")[0] < 0.01


def test_null_and_clashing_columns_in_toxicity(spark, make, clash, corpus):
    m = toxicity.Model(-8.0, {"that": 12.0})
    docs = clash(make(corpus))
    assert toxicity.apply(docs, m).count() == len(corpus)
    kept = toxicity.keep(docs, m)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in corpus if not re.search(r"\bthat\b", (t or "").lower()))


def test_signs_behind_words_and_small_memory(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 20_000)
    vocabulary = queries.vocabulary()
    codec = byte_bpe.Codec(vocabulary)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.parse(), special_tokens={})
    some, letters = random.Random(7), list("aZé.,'’!?&_-#s dtm\n \x01×÷ª²9ß中😀`~{@ \t lvre")
    for _ in range(20):
        texts = ["".join(some.choice(letters) for _ in range(some.randrange(60))) for _ in range(100)] + ["word. it's, l'eau!! (so) a'. x_y_ ciónñ&&&", ""]
        ids, ends = codec.encode(pa.array(texts))
        assert [x.tolist() for x in byte_bpe._split(ids, ends)] == [plain.encode_ordinary(t) for t in texts]
        assert [x.tobytes().decode() for x in byte_bpe._split(*codec.decode(ids, ends))] == texts
    # a batch's own words may stand above the bound; the next one forgets the least used, and known ones keep their values
    codec.encoded.missing([])
    assert codec.encoded.bytes <= 20_000 and len(codec.encoded.place) == len(codec.encoded.uses) == len(codec.encoded.edge) - 1
    codec.close()


def test_texts_are_encoded_in_small_slices_whose_memory_goes_back(monkeypatch):
    given = []
    monkeypatch.setattr(byte_bpe, "give_back", lambda: given.append(1), raising=False)
    rows = [None, "", "a" * 300_000, *["b c " * 75_000] * 12, "d" * 5_000_000, "e"]
    batch = pa.record_batch([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names=["doc_id", "text"])
    parts = list(byte_bpe._parts([batch]))
    assert [x for p in parts for x in p["text"].to_pylist()] == rows
    # a megabyte and what a row has above it, but for the long row, whole
    assert all(sum(len(x or "") for x in p["text"].to_pylist()) < (1 << 20) + 300_000 for p in parts if 13 + 2 not in p["doc_id"].to_pylist())
    assert len(given) == len(parts) > 4
