"""Several bundles as one: search, pins, links and release."""

import pytest

from kbengine import api
from kbengine.sources import bundle as B
from kbengine.workspace import Workspace


@pytest.fixture
def own(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.md").write_text("# One\n")
    bundles = {}
    for name in ("left", "right", "law"):
        bundles[name] = b = api.Bundle(spark, f"file://{tmp_path}/{name}")
        b.init(f"file://{tmp_path}/corpus")
    page = lambda b, cid, title, body="", **more: bundles[b]._document(cid, {"type": "Note", "title": title} | more, body)
    page("left", "notes/car", "Motor car", "wheels and engine\n")
    page("left", "notes/tree", "Oak tree")
    page("right", "notes/auto", "Automobile", "wheels\n", aliases=["Motor"])
    page("right", "notes/tree", "Oak tree")
    page("law", "rules/speed", "Speed limit", "a rule\n")
    w = Workspace(spark, f"file://{tmp_path}/ws")
    w.init([{"name": n, "path": b.root, "role": "constraints" if n == "law" else "knowledge"} for n, b in bundles.items()])
    row = lambda src, rel, dst, status="accepted": {"src": src, "rel": rel, "dst": dst, "status": status, "origin": "llm"}
    w.link("left", "right", [row("left:notes/car", "same-as", "right:notes/auto")])
    w.link("law", "left", [row("law:rules/speed", "constrains", "right:notes/auto"), row("law:rules/speed", "constrains", "left:notes/tree", "proposed")])
    return w, bundles


def test_federated_query(own):
    w, bundles = own
    top, bound = w.query("engine car")
    got = top.orderBy("role", "place").collect()
    # by the same-as row the right member is asked for its own name as well
    assert [(r.role, r.ref, r.duplicates) for r in got] == [("knowledge", "left:notes/car", ["right:notes/auto"])]
    assert got[0].score == pytest.approx(2 / 61)
    assert [r.ref for r in bound.collect()] == ["law:rules/speed"]


def test_pins_of_lexicons_come_first(own):
    w, bundles = own
    rows = [{"term": "engine", "status": "accepted", "maps_to": ["notes/tree", "notes/none"], "canonical_terms": []}]
    bundles["left"]._document("meta/lexicon", {"type": "Meta", "title": "Lexicon", "rows": rows}, "")
    top, _ = w.query("engine")
    assert {r.ref: r.score for r in top.collect()} == {"left:notes/tree": pytest.approx(1 / 61), "left:notes/car": pytest.approx(1 / 62)}


def test_changes_since_the_pin_silence_links(own):
    w, bundles = own
    assert {r.member: (r.state, r.changed) for r in w.status().collect()} == {n: ("ok", 0) for n in bundles}
    assert w.active().count() == 2
    bundles["right"]._document("notes/auto", {"type": "Note", "title": "Automobile", "x": "y"}, "other\n")
    assert [r.ref for r in w.changed().collect()] == ["right:notes/auto"] and w.active().count() == 0
    row = w.release_check().first()
    found = dict(x.split("=") for x in row.problems.split(","))
    want = {"E_REL_WS_MEMBER_UNACCEPTED": "3", "E_REL_WS_MEMBER_DRIFT": "1", "E_REL_WS_CROSSWALK_STALE": "2", "E_REL_WS_EVAL_SURFACE": "1", "E_REL_WS_EVAL_MISSING": "1"}
    assert not row.ok and found == want
    w.pin()
    assert w.active().count() == 2


def test_links_and_show(own):
    w, _ = own
    got = {(r.src, r.dst): (r.status, r.origin) for r in w.link_candidates().collect()}
    assert got == {("left:notes/tree", "right:notes/tree"): ("accepted", "alias-exact")}
    assert "Motor car" in w.show("left:notes/car")
    for ref, kind in (("notes/car", ValueError), ("none:x", KeyError), ("left:none", KeyError)):
        with pytest.raises(kind):
            w.show(ref)
    with pytest.raises(ValueError):
        w.link("left", "right", [{"src": "x", "rel": "same-as", "dst": "right:y", "status": "accepted"}])


def test_no_links_at_all(own, spark):
    w, bundles = own
    lone = Workspace(spark, w.root + "2")
    lone.init([{"name": "left", "path": bundles["left"].root, "role": "knowledge"}])
    top, bound = lone.query("oak")
    assert [r.ref for r in top.collect()] == ["left:notes/tree"] and bound.count() == 0
    assert B.parse(lone.show("left:notes/tree"))[0]["title"] == "Oak tree"
