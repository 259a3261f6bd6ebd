"""The pipeline's stages on planted documents, and its end against the tokenizer's library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from kbengine.llm import queries

from .conftest import prose


def plant(spark, tmp_path):
    rng = random.Random(8)
    rows = [prose(rng, 60) for _ in range(120)]
    for k in range(0, 120, 4):
        rows[k] += " You vilest vilest thing, gruesome vilest."
    labels = [(k, 1, int(k % 4 == 0)) for k in range(100)]
    items = [(1, prose(rng, 30)), (2, prose(rng, 25))]
    near = prose(rng, 150)
    lines = "\n".join(prose(rng, 9) for _ in range(20))
    extra = {
        200: near, 201: near + " more", 202: prose(rng, 20) + " " + items[0][1] + " " + prose(rng, 20), 203: lines, 204: prose(rng, 30) + "\n" + lines + "\n" + prose(rng, 30),
        205: "\n".join(lines.split("\n")), 206: None, 207: "",
    }
    docs = list(enumerate(rows)) + list(extra.items())
    out = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, dict(docs)


def test_stages(spark, tmp_path):
    sf, texts = plant(spark, tmp_path)
    docs = queries.table(spark, sf, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == names
            path = f"{sf}/{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/toxicity").collect()}
    assert ids == {i for i in texts if i >= 200 or i % 4}
    lines = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/line_dedup").collect()}
    assert 205 not in lines and lines[203] == texts[203] and len(lines[204]) < len(texts[204]) and lines[206] is None
    assert set(lines) == ids - {205}
    near = {r.doc_id for r in spark.read.parquet(f"{sf}/jaccard_join").collect()}
    assert near == set(lines) - {201}
    clean = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/decontamination").collect()}
    assert set(clean) == near - {202}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.vocabulary().parse(), special_tokens={})
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: hashlib.sha256(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for i, t in clean.items()}


def test_operators_survive_an_empty_table(spark, tmp_path):
    sf, _ = plant(spark, tmp_path)
    docs = queries.table(spark, sf, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


