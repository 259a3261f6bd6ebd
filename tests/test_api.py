"""The verbs on a small bundle, and logs as streams."""

import json

import pytest
from pyspark.sql import functions as F

from kbengine import api
from kbengine.sources import bundle as B
from kbengine.sources import store
from kbengine.streaming import logs


@pytest.fixture
def own(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.md").write_text("# One\nline two\n")
    (tmp_path / "corpus" / "b.md").write_text("b\n")
    b = api.Bundle(spark, f"file://{tmp_path}/bundle")
    b.init(f"file://{tmp_path}/corpus")
    b._document("notes/x", {"type": "Note", "title": "Iron condor", "sources": ["a.md#L1-L2"]}, "See [y](y.md) and [z](gone/y.md).\n")
    b._document("notes/y", {"type": "Note", "title": "Calendar", "sources": ["a.md#L9", "lost.md"]}, "iron\n")
    return b, tmp_path


def test_query_show_links(own):
    b, _ = own
    top, _ = b.query("iron condor")
    assert [r.id for r in top.orderBy("rank").collect()] == ["notes/x", "notes/y"]
    assert "Iron condor" in b.show("notes/x")
    with pytest.raises(KeyError):
        b.show("../etc")
    got = {r.id: (r.out, r.backlinks) for r in b.links().where("id LIKE 'notes/%'").collect()}
    assert got["notes/y"] == ([], ["notes/x"]) and got["notes/x"][0] == ["notes/y", "notes/gone/y"]
    assert [(r.suggestion, r.outcome) for r in b.repair_links().collect()] == [("notes/y", "exact")]


def test_drift_checks_and_release(own):
    b, tmp = own
    codes = {(r.code, r.path) for r in b.validate().collect()}
    assert {("W_BAD_SOURCE", "notes/y"), ("W_BAD_ANCHOR", "notes/y"), ("W_DANGLING_LINK", "notes/x"), ("W_ORPHAN", "notes/x"), ("E_META_FIELD", "meta/purpose")} <= codes
    assert ("W_BAD_ANCHOR", "notes/x") not in codes
    (tmp / "corpus" / "a.md").write_text("changed\n")
    (tmp / "corpus" / "c.md").write_text("new\n")
    assert sorted((r.path, r.change) for r in b.diff().collect()) == [("a.md", "changed"), ("c.md", "added")]
    plan = b.update_plan()
    assert sorted(r.id for r in plan["affected"].collect()) == ["notes/x", "notes/y"] and [r.path for r in plan["uncovered_new"].collect()] == ["c.md"]
    assert not b.release_check().first().ok


def test_writes(own, spark):
    b, tmp = own
    p = b.propose("notes/New One", "create", B.serialise({"type": "Note", "title": "New"}, "text\n"))
    b.accept(p)
    assert "New" in b.show("notes/New One") and store.read(spark, f"{b.root}/{p}.md") is None
    b.stale("notes/y", "old")
    assert B.parse(b.show("notes/y"))[0]["stale_reason"] == "old"
    b.stale("notes/y", None)
    b.log("first", "2024-01-01")
    b.log("second", "2024-01-02")
    b.log("third", "2024-01-02")
    text = store.read(spark, f"{b.root}/log.md")
    assert text.index("third") < text.index("second") < text.index("2024-01-01")
    first = b.package()
    assert b.package() == first and "[Iron condor](notes/x.md)" in store.read(spark, f"{b.root}/index.md")
    b.ledger_add("r1", "s1", ["a.md", "zz"], ["notes/x"], "p1", merge_map={"drafts/a": "notes/x", "drafts/b": "notes/x"})
    row = b.log_rows("ledger", api.LEDGER).first()
    assert row.input_hashes["zz"] == "unknown" and len(row.input_hashes["a.md"]) == 64
    with pytest.raises(ValueError):
        b.ledger_add("r1", "s1", [], [], "p1", spans={"covered": {}})
    b.dissent_add("notes/x", ["drafts/a"], "split", "r1")
    assert b.log_rows("dissent", api.DISSENT).first().verdict == "split"


def test_segments_jobs_source_map(own, spark):
    b, tmp = own
    b._document("meta/extraction-plan", {"type": "Meta", "archetype": "a", "archetype_version": 1, "segments": [{"id": "segment-01", "status": "done", "files": ["a.md", {"path": "b.md", "lines": "1-1"}]}]}, "")
    assert [r.span for r in b.segments().orderBy("span").collect()] == ["a.md", "b.md#L1-1"]
    assert [r.path for r in b.glean().collect()] == ["b.md"]
    job = b.freeze_job("segment-01", "do it", {"model": "m"})
    assert json.loads(store.read(spark, f"{b.root}/meta/jobs/segment-01.json"))["digest"] == job["digest"] and all(i["sha256"] for i in job["inputs"])
    rows = [json.loads(x) for x in api.normalise(spark, f"file://{tmp}/corpus", f"file://{tmp}/norm").toJSON().collect()]
    B.append_log(spark, f"{b.root}/meta/source-map.jsonl", [*rows, {**rows[0], "text_sha256": "0"}, {**rows[0], "normalized_lines": "x"}])
    assert sorted(r.state for r in b.source_map().collect()) == ["E_SOURCEMAP_LINES", "E_SOURCEMAP_TEXT_DRIFT", "verified", "verified"]
    assert b.segment(1000).count() == 2


def test_streams(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for k in range(3):
        (tmp_path / "log" / f"{k}.json").write_text(json.dumps({"segment": "s", "ord": k, "verdict": f"v{k}"}) + "\n")
    rows = logs.follow(spark, str(tmp_path / "log"), "segment string, ord int, verdict string")
    q = logs.latest(rows, "segment", "ord", "verdict").writeStream.outputMode("complete").format("memory").queryName("latest_rows").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("latest_rows").collect()] == [("s", "v2")]
    assert logs.per_window(spark.range(3).select(F.current_timestamp().alias("at")), "at", "1 hour", "1 hour").agg(F.sum("n")).first()[0] == 3
