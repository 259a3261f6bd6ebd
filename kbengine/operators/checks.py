"""Validation: each check gives findings as level, code, path, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import curation, reports

# Fixed tables: what documents about the bundle itself must say.
META_REQUIRED = {"purpose": ["language", "write_policy", "test_queries"], "extraction-plan": ["archetype", "archetype_version"], "corpus": ["corpus", "extracted_at"]}
WRITE_POLICIES = ("proposals", "direct")
LEXICON_STATUSES = ("accepted", "ambiguous", "not-covered")
QUALITY_VERDICTS = ("pass", "fail", "uncertain")


def level(strict: bool) -> tuple[str, str]:
    """Level and prefix of a check that is a warning unless strict."""
    return ("error", "E_") if strict else ("warning", "W_")


def found(rows: DataFrame, code: str | Column, path: str | Column, message: Column | str, level_: str = "error") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(F.lit(level_).alias("level"), lit(code).alias("code"), (F.col(path) if isinstance(path, str) else path).alias("path"), lit(message).cast("string").alias("message"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blank(value: Column) -> Column:
    return value.isNull() | value.isin("", "[]", "null")


def conformance(concepts: DataFrame) -> DataFrame:
    bad = concepts.where(F.col("parse_error").isNotNull())
    no_type = concepts.where(F.col("parse_error").isNull() & (F.trim(F.coalesce("type", F.lit(""))) == ""))
    return union(found(bad, "E_FRONTMATTER", F.concat("id", F.lit(".md")), F.col("parse_error")), found(no_type, "E_TYPE", F.concat("id", F.lit(".md")), "type missing or empty"))


def reserved(files: DataFrame) -> DataFrame:
    """Of path, text: an index with frontmatter, a log with headings that are no dates."""
    index = files.where((F.col("path") == "index.md") & F.col("text").startswith("---"))
    heads = files.where(F.col("path") == "log.md").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1))).alias("h"))
    no_date = heads.where(~F.col("h").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date("h", "yyyy-MM-dd").isNull())
    return union(found(index, "E_INDEX_FRONTMATTER", "path", "the index has frontmatter"), found(no_date, "E_LOG_DATE", "path", F.concat(F.lit("no date: "), "h")))


def required_meta(concepts: DataFrame) -> DataFrame:
    spark = concepts.sparkSession
    want = spark.createDataFrame([(f"meta/{k}", f) for k, fs in META_REQUIRED.items() for f in fs], "id string, field string")
    have = concepts.select("id", "meta")
    missing = want.select("id").distinct().join(have, "id", "left_anti")
    empty = want.join(have, "id").where(blank(F.col("meta")[F.col("field")]))
    return union(found(missing, "E_META_MISSING", F.concat("id", F.lit(".md")), "required document missing"), found(empty, "E_META_FIELD", "id", F.concat(F.lit("missing or empty: "), "field")))


def write_policy(concepts: DataFrame) -> DataFrame:
    v = F.col("meta")["write_policy"]
    return found(concepts.where((F.col("id") == "meta/purpose") & ~blank(v) & ~v.isin(*WRITE_POLICIES)), "E_WRITE_POLICY", "id", v)


def acceptance(policy: object, n_queries: int, n_adversarial: int) -> list[tuple[str, str]]:
    """Problems of a bundle's release policy, a small mapping: closed keys, types, reachable bars, no idle waiver."""
    if policy is None:
        return []
    if not isinstance(policy, dict):
        return [("E_ACCEPTANCE_SHAPE", "no mapping")]
    bars = {"min_owner_pass": n_queries, "min_adversarial_pass": n_adversarial}
    flags = {"allow_l3_fail", "allow_open_dissent", "allow_injection"}
    out = []
    for k, v in policy.items():
        if k in bars:
            if isinstance(v, bool) or not isinstance(v, int):
                out.append(("E_ACCEPTANCE_TYPE", f"{k} must be an integer"))
            elif not 1 <= v <= max(bars[k], 1):
                out.append(("E_ACCEPTANCE_RANGE", f"{k}={v} outside 1..{bars[k]}"))
        elif k in flags:
            if not isinstance(v, bool):
                out.append(("E_ACCEPTANCE_TYPE", f"{k} must be true or false"))
        elif k == "dissent":
            if v != "required":
                out.append(("E_ACCEPTANCE_VALUE", f"{k}={v!r}"))
        else:
            out.append(("E_ACCEPTANCE_KEY", f"unknown key {k!r}"))
    if policy.get("allow_open_dissent") and policy.get("dissent") != "required":
        out.append(("E_ACCEPTANCE_INERT", "allow_open_dissent without dissent"))
    return out


def adversarial_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of query, expect, concept, why: blank queries, unknown expectations, covered ones without a target that exists."""
    known = rows.join(ids.select(F.col("id").alias("concept"), F.lit(True).alias("there")), "concept", "left")
    field = known.where((F.trim(F.coalesce("query", F.lit(""))) == "") | ~F.coalesce(F.col("expect").isin("covered", "not-covered"), F.lit(False)))
    target = known.where((F.col("expect") == "covered") & F.col("there").isNull())
    at = F.lit("meta/purpose")
    return union(found(field, "E_ADVERSARIAL_FIELD", at, F.coalesce("query", F.lit(""))), found(target, "E_ADVERSARIAL_TARGET", at, F.coalesce("concept", F.lit(""))))


def declared_types(concepts: DataFrame, declared: list[str], canonical: list[str], strict: bool = False) -> DataFrame:
    """Finals whose type the plan doesn't declare, and declared types that the archetype doesn't know."""
    lv, p = level(strict)
    spark = concepts.sparkSession
    unknown = spark.createDataFrame([(x,) for x in declared if x not in canonical], "type string")
    loose = concepts.where((F.col("kind") == "final") & ~F.coalesce(F.col("type").isin(*declared), F.lit(False)))
    return union(found(unknown, "E_UNKNOWN_TYPE", F.lit("meta/extraction-plan"), F.col("type")), found(loose, p + "UNDECLARED_TYPE", "id", F.col("type"), lv))


def id_collisions(concepts: DataFrame) -> DataFrame:
    """Ids that differ in case only, each with the one before."""
    before = F.lag("id").over(Window.partitionBy(F.lower("id")).orderBy(T.path_key(F.col("id"))))
    return found(concepts.select("id", before.alias("other")).where("other IS NOT NULL"), "E_ID_COLLISION", "id", F.col("other"))


def stale_fields(concepts: DataFrame) -> DataFrame:
    since = F.col("meta")["stale_since"]
    return union(
        found(concepts.where(F.col("stale") & blank(F.col("stale_reason"))), "E_STALE_FIELDS", "id", "stale without a reason"),
        found(concepts.where(F.col("stale") & (since.isNull() | F.try_to_date(since, "yyyy-MM-dd").isNull())), "E_STALE_FIELDS", "id", "stale without a date"),
    )


def source_existence(citations: DataFrame, manifest: DataFrame, strict: bool = False) -> DataFrame:
    """Citations of files that the manifest lacks."""
    lv, p = level(strict)
    own = citations.withColumn("path", T.source_path(F.col("source")))
    return found(own.join(manifest.select("path"), "path", "left_anti"), p + "BAD_SOURCE", "id", F.col("source"), lv)


def coverage(segments: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: files and bytes of done segments, of them cited ones, and both shares in percent, half to even."""
    cited = citations.select(T.source_path(F.col("source")).alias("path")).distinct().withColumn("hit", F.lit(1))
    done = segments.where("status = 'done'").groupBy("path").agg(F.max("bytes").alias("bytes"))
    out = done.join(cited, "path", "left").agg(F.count(F.lit(1)).alias("files"), F.count("hit").alias("cited"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("hit") == 1, F.col("bytes")).otherwise(0)).alias("cited_bytes"))
    return out.select("files", "cited", "bytes", "cited_bytes", F.bround(100 * F.col("cited") / F.col("files")).cast("long").alias("files_pct"), F.when(F.col("bytes") > 0, F.bround(100 * F.col("cited_bytes") / F.col("bytes"))).cast("long").alias("bytes_pct"))


def uncited(segments: DataFrame, citations: DataFrame) -> DataFrame:
    cited = citations.select(T.source_path(F.col("source")).alias("path")).distinct()
    return segments.where("status = 'done'").groupBy("path").agg(F.max("bytes").alias("bytes")).join(cited, "path", "left_anti")


def outside_scope(citations: DataFrame, segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cited files of the corpus that no segment plans."""
    cited = citations.select(T.source_path(F.col("source")).alias("path")).distinct()
    return found(cited.join(segments.select("path"), "path", "left_anti").join(manifest.select("path"), "path", "left_semi"), "W_SOURCE_OUTSIDE_SCOPE", "path", "cited but not planned", "warning")


def span_partition(assigned: DataFrame, reported: DataFrame) -> DataFrame:
    """Of segment, span and segment, span, class: spans in two classes, without one, and invented ones."""
    seen = reported.groupBy("segment", "span").agg(F.countDistinct("class").alias("classes"))
    both = assigned.select("segment", "span", F.lit(1).alias("planned")).distinct().join(seen, ["segment", "span"], "full_outer")
    code = F.when(F.col("planned").isNull(), "E_SPAN_UNKNOWN").when(F.col("classes").isNull(), "E_SPAN_UNACCOUNTED").when(F.col("classes") > 1, "E_SPAN_DOUBLE")
    return found(both.withColumn("code", code).where("code IS NOT NULL"), F.col("code"), "segment", F.col("span"))


def span_contradiction(reported: DataFrame, uncited_: DataFrame) -> DataFrame:
    """Segments that report a file as covered which no concept cites; one finding a segment and path."""
    own = reported.where("class = 'covered'").select("segment", F.substring_index("span", "#", 1).alias("path")).distinct()
    return found(own.join(uncited_.select("path"), "path", "left_semi"), "W_SPAN_COVERAGE_CONTRADICTION", "segment", F.col("path"), "warning")


def anchors(citations: DataFrame, corpus: DataFrame, strict: bool = False) -> DataFrame:
    """Line anchors past the end or backwards, and heading anchors that no heading has."""
    lv, p = level(strict)
    first, last = T.line_anchor(F.col("source"))
    own = citations.withColumns({"path": T.source_path(F.col("source")), "first": first, "last": last, "anchor": F.when(F.instr("source", "#") > 0, F.substring_index("source", "#", -1))}).where("anchor IS NOT NULL")
    lines = F.size(F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)))
    met = own.join(corpus.select("path", lines.alias("n_lines"), T.heading_slugs(F.col("text")).alias("slugs")), "path")
    bad = (F.col("first").isNotNull() & ((F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("last") > F.col("n_lines")))) | (F.col("first").isNull() & ~F.array_contains("slugs", F.lower("anchor")))
    return found(met.where(bad), p + "BAD_ANCHOR", "id", F.col("source"), lv)


def lexicon(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of term, status, maps_to: unknown status, blank term, targets that don't exist."""
    at = F.lit("meta/lexicon")
    status = rows.where(~F.coalesce(F.col("status").isin(*LEXICON_STATUSES), F.lit(False)))
    no_term = rows.where(F.trim(F.coalesce("term", F.lit(""))) == "")
    targets = rows.select("term", F.explode("maps_to").alias("id")).join(ids.select("id"), "id", "left_anti")
    return union(found(status, "W_LEXICON_STATUS", at, F.col("term"), "warning"), found(no_term, "W_LEXICON_ROW", at, "blank term", "warning"), found(targets, "W_LEXICON_TARGET", at, F.col("id"), "warning"))


def dangling(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    return found(curation.dangling(edges, concepts), "W_DANGLING_LINK", "src", F.col("dst"), "warning")


def orphans(edges: DataFrame, concepts: DataFrame, index_targets: DataFrame | None = None, strict: bool = False) -> DataFrame:
    lv, p = level(strict)
    return found(curation.orphans(edges, concepts, index_targets), p + "ORPHAN", "id", "nothing links here", lv)


def fitness(sampled: DataFrame, checks: DataFrame, rows: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """The purpose-fitness table: rows of concept_id, check_id, verdict, evidence for every sampled concept and check.

    ``checks`` are an archetype's few prompts; pairing them with the sample is its contract.
    """
    lv, p = level(strict)
    at = F.lit("meta/purpose-fitness")
    want = sampled.select(F.col("id").alias("concept_id"), F.explode(F.array(*[F.lit(c.check_id) for c in checks.collect()])).alias("check_id")) if isinstance(checks, DataFrame) else sampled
    missing = want.join(rows.select("concept_id", "check_id"), ["concept_id", "check_id"], "left_anti")
    twice = rows.groupBy("concept_id", "check_id").count().where("count > 1")
    verdict = rows.where(~F.coalesce(F.col("verdict").isin(*QUALITY_VERDICTS), F.lit(False)))
    evidence = rows.where(F.trim(F.coalesce("evidence", F.lit(""))) == "")
    stranger = rows.join(ids.select(F.col("id").alias("concept_id")), "concept_id", "left_anti")
    pair = F.concat_ws("/", "concept_id", "check_id")
    return union(*(found(r, f"{p}QUALITY_{c}", at, pair, lv) for r, c in ((missing, "ROW"), (twice, "DUP"), (verdict, "VERDICT"), (evidence, "EVIDENCE"), (stranger, "UNKNOWN_ID"))))


def provenance(jobs: DataFrame, ledger: DataFrame, strict: bool = False) -> DataFrame:
    """Of segment, digest, recomputed, prompt_sha256, prompt_now and segment, job_digest: broken digests, changed prompts, ledger rows that follow another job."""
    lv, p = level(strict)
    broken = jobs.where("digest != recomputed")
    prompt = jobs.where("prompt_now IS NULL OR prompt_sha256 != prompt_now")
    other = ledger.where("job_digest IS NOT NULL").join(jobs.select("segment", "digest"), "segment").where("job_digest != digest")
    no_job = ledger.where("job_digest IS NOT NULL").join(jobs.select("segment"), "segment", "left_anti")
    return union(*(found(r, f"{p}PROV_{c}", "segment", m, lv) for r, c, m in ((broken, "DIGEST", "digest differs"), (prompt, "PROMPT", "prompt changed"), (other, "LEDGER_DIGEST", "another job"), (no_job, "LEDGER_JOB", "no job"))))


def package_fresh(recorded: str | None, current: str) -> list[tuple[str, str]]:
    return [("W_PACKAGE_MISSING", "")] if recorded is None else [] if recorded == current else [("W_STALE_PACKAGE", recorded)]


def injection(texts: DataFrame, strict: bool = False) -> DataFrame:
    lv, p = level(strict)
    own = reports.injection(texts)
    return found(own, p + "INJECTION", "path", F.concat_ws(":", "line", "rule"), lv)


def missing_sources(concepts: DataFrame) -> DataFrame:
    own = concepts.where((F.col("kind") == "final") & (F.size("sources") == 0))
    return found(own, "W_NO_SOURCES", "id", "no sources", "warning")


def archetype(concepts: DataFrame, rules: dict) -> DataFrame:
    """Rules of a concept's type: required_fields, required_sections, link_rules, field_enums, nonempty_sections.

    Rule tables are small constants, so they become conditions of one pass over the concepts.
    """
    out = []
    of = lambda t: F.lit(True) if t == "_all" else F.coalesce(F.col("type") == t, F.lit(False))
    meta = F.col("meta")
    problem = lambda when, code, message: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))
    for t, fields in rules.get("required_fields", {}).items():
        out += [problem(of(t) & blank(meta[f]), "E_REQUIRED_FIELD", f) for f in fields]
    for t, names in rules.get("required_sections", {}).items():
        out += [problem(of(t) & ~F.col("body").rlike(rf"(?im)^#{{1,6}}[ \t]+\Q{s}\E[ \t]*$"), "E_REQUIRED_SECTION", s) for s in names]
    for r in rules.get("link_rules", []):
        scope = T.section(F.col("body"), r["section"]) if r.get("section") else F.col("body")
        targets = F.regexp_extract_all(scope, F.lit(r"\]\(/([^)#\s]+?)(?:\.md)?\)"), F.lit(1))
        pattern = "^(?:" + "|".join(r"\Q" + d + r"\E" for d in r.get("to_dirs", [])) + ")"
        n = F.size(F.filter(targets, _matches(pattern)))
        out.append(problem(of(r["from"]) & scope.isNotNull() & (n < int(r.get("min", 1))), "E_LINK_RULE", r.get("section") or "body"))
    for t, enums in rules.get("field_enums", {}).items():
        out += [problem(of(t) & meta[f].isNotNull() & ~meta[f].isin(*map(str, allowed)), "E_FIELD_ENUM", f) for f, allowed in enums.items()]
    for t, names in rules.get("nonempty_sections", {}).items():
        out += [problem(of(t) & ~T.section(F.col("body"), s).rlike(r"\S"), "E_EMPTY_SECTION", s) for s in names]
    own = concepts.where(~F.col("id").startswith("meta/")).select("id", F.explode(F.array_compact(F.array(*out))).alias("p"))
    return own.select(F.lit("error").alias("level"), F.col("p.code").alias("code"), F.col("id").alias("path"), F.col("p.message").alias("message"))


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)
