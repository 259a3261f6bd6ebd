"""Release of a bundle: what isn't shown to hold is a problem."""

from kbengine import api


def test_release_predicates(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.md").write_text("# One\nline two\n")
    b = api.Bundle(spark, f"file://{tmp_path}/bundle")
    b.init(f"file://{tmp_path}/corpus")
    plan = [{"id": f"segment-0{k}", "status": s, "files": ["a.md"]} for k, s in enumerate(("done", "done", "done", "pending"))]
    b._document("meta/extraction-plan", {"type": "Meta", "title": "Plan", "segments": plan}, "")
    for k, classes in ((0, {"covered": {"a.md": ["drafts/a"]}}), (1, {"dropped": {"a.md": "no time"}})):
        job = b.freeze_job(f"segment-0{k}", "do it")
        b.ledger_add("r", f"segment-0{k}", ["a.md"], [], "p", job_digest=job["digest"], spans=classes)
    b.ledger_add("r", "segment-00", [], [], "p", merge_map={"drafts/a": "notes/x", "drafts/b": "notes/x"})
    b._document("meta/purpose", b.meta("purpose") | {"acceptance": {"dissent": "required"}}, "")
    row = b.release_check().first()
    assert not row.ok
    found = dict(x.split("=") for x in row.problems.split(","))
    want = {"E_REL_SEGMENTS": "1", "E_REL_JOB_MISSING": "2", "E_REL_SPAN_COVERAGE_MISSING": "1", "E_REL_SPAN_DROPPED": "1", "E_REL_EVAL_SURFACE": "1", "E_REL_EVAL_MISSING": "1", "E_REL_DISSENT_UNADJUDICATED": "1"}
    assert {k: v for k, v in found.items() if k in want or "LEDGER" in k} == want
