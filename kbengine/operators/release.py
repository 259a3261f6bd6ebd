"""Release: predicates over the tables, all of which must hold; what can't be shown to hold is a problem.

Each predicate gives rows of code, message. A verdict is fine when there are none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import latest_run, verdict_status

MIN_OWNER_PASS = 8
MIN_ADVERSARIAL = 10


def problem(rows: DataFrame, code: str, message) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), message.cast("string").alias("message"))


def validated(findings: DataFrame) -> DataFrame:
    """Errors of the strict checks."""
    return problem(findings.where("level = 'error'"), "E_REL_VALIDATE", F.concat_ws(" ", "code", "path", "message"))


def injection_free(findings: DataFrame, allow_phrases: bool = False) -> DataFrame:
    """No finding of the scan; a declared hatch waives phrase rules, never invisible characters."""
    own = findings.where("rule = 'invisible-unicode'") if allow_phrases else findings
    return problem(own, "E_REL_INJECTION", F.concat_ws(":", "path", "line", "rule"))


def provenance_complete(segments: DataFrame, jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every segment done, with a job, and with a ledger row that follows that job."""
    undone = segments.where("status != 'done'")
    no_job = segments.join(jobs.select("segment"), "segment", "left_anti")
    rows = ledger.where("job_digest IS NOT NULL").select("segment", F.col("job_digest").alias("digest"))
    no_row = jobs.join(rows, ["segment", "digest"], "left_anti")
    parts = ((undone, "E_REL_SEGMENTS"), (no_job, "E_REL_JOB_MISSING"), (no_row, "E_REL_LEDGER_JOB"))
    return reduce(DataFrame.unionByName, (problem(r.select("segment").distinct(), c, F.col("segment")) for r, c in parts))


def spans_reported(segments: DataFrame, latest: DataFrame) -> DataFrame:
    """Every done segment has outcomes, and none dropped a span. ``latest`` has segment, class, span."""
    silent = segments.where("status = 'done'").select("segment").distinct().join(latest.select("segment"), "segment", "left_anti")
    dropped = latest.where("class = 'dropped'")
    return problem(silent, "E_REL_SPAN_COVERAGE_MISSING", F.col("segment")).unionByName(problem(dropped, "E_REL_SPAN_DROPPED", F.concat_ws(" ", "segment", "span")))


def surface(queries: DataFrame, least: int, code: str) -> DataFrame:
    """At least so many queries, none blank and none repeated but for case and spaces."""
    folded = queries.select(F.lower(F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", " "))).alias("q"))
    counts = folded.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    few = folded.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return problem(few, code, F.concat(F.col("n").cast("string"), F.lit(f" of {least}"))).unionByName(problem(counts.where("q = ''"), code, F.lit("blank query"))).unionByName(problem(counts.where("q != '' AND n > 1"), code, F.concat(F.lit("repeated: "), "q")))


def evaluated(runs: DataFrame, results: DataFrame, suite: str, fingerprint: str, least: int) -> DataFrame:
    """The suite's last run is there, of the current retrieval, confirmed by the owner, and passes.

    Runs of other suites don't count. ``runs`` has run_id, suite, ord,
    retrieval_fingerprint; ``results`` has run_id and the verdicts.
    """
    kind = "EVAL" if suite == "acceptance" else "ADVERSARIAL"
    last = latest_run(runs, suite)
    one = runs.sparkSession.range(1)
    missing = one.join(last.select(F.lit(0).cast("long").alias("id")), "id", "left_anti")
    stale = last.where(F.col("retrieval_fingerprint") != fingerprint)
    status = verdict_status(results.join(last.select("run_id"), "run_id", "left_semi"))
    return reduce(
        DataFrame.unionByName,
        (
            problem(missing, f"E_REL_{kind}_MISSING", F.lit(suite)),
            problem(stale, f"E_REL_{kind}_STALE", F.col("run_id")),
            problem(status.where("provisional"), f"E_REL_{kind}_PROVISIONAL", F.col("owner_confirmed")),
            problem(status.where(F.col("passed") < least), f"E_REL_{kind}_POLICY", F.col("passed")),
        ),
    )


def fitness(rows: DataFrame, allow_fail: bool = False) -> DataFrame:
    none = problem(rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "E_REL_L3_MISSING", F.col("n"))
    return none if allow_fail else none.unionByName(problem(rows.where("verdict = 'fail'"), "E_REL_L3_FAIL", F.concat_ws("/", "concept_id", "check_id")))


DISSENT = {"unadjudicated": "E_REL_DISSENT_UNADJUDICATED", "open": "E_REL_DISSENT_OPEN", "stale": "E_REL_DISSENT_STALE"}


def dissent(states: DataFrame, allow_open: bool = False) -> DataFrame:
    """``states`` has group, state; closed groups are fine, open ones where that is allowed."""
    codes = {k: v for k, v in DISSENT.items() if not (allow_open and k == "open")}
    return reduce(DataFrame.unionByName, (problem(states.where(F.col("state") == k), v, F.col("group")) for k, v in codes.items()))


def members(accepted: DataFrame, pins: DataFrame) -> DataFrame:
    """A workspace's members: member, readable, accepted, and member, pinned, current; what can't be compared is unverifiable."""
    parts = (
        (accepted.where("NOT readable"), "UNREADABLE"), (accepted.where("readable AND NOT accepted"), "UNACCEPTED"),
        (pins.where("pinned IS NULL OR current IS NULL"), "UNVERIFIABLE"), (pins.where("pinned != current"), "DRIFT"),
    )
    return reduce(DataFrame.unionByName, (problem(r, f"E_REL_WS_MEMBER_{c}", F.col("member")) for r, c in parts))


def crosswalk_fresh(crosswalk: DataFrame, active: DataFrame) -> DataFrame:
    gone = crosswalk.where("status = 'accepted'").select("src", "rel", "dst").join(active.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti")
    return problem(gone, "E_REL_WS_CROSSWALK_STALE", F.concat_ws(" ", "src", "rel", "dst"))


def verdict(*predicates: DataFrame) -> DataFrame:
    """One row: ok, and the number of problems by code as sorted ``code=n`` strings."""
    rows = reduce(DataFrame.unionByName, predicates).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("codes"), F.array_join(F.array_sort(F.collect_list(F.concat("code", F.lit("="), F.col("n").cast("string")))), ",").alias("problems")).select((F.col("codes") == 0).alias("ok"), "problems")
