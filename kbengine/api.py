"""A bundle's verbs, as methods: each reads tables, calls the operators, and writes small files where it must."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import checks, corpus, curation, release, reports, retrieval
from .sources import bundle as B
from .sources import store

#: Stands for the rules by which queries rank and expand; a recorded evaluation holds while it stays.
RULES_VERSION = "1"
LEDGER = "run_id string, segment string, inputs array<string>, input_hashes map<string,string>, prompt_version string, outputs array<string>, validation string, commit string, merge_map map<string,string>, job_digest string"
DISSENT = "run_id string, group string, drafts array<string>, claim string, anchor string, verdict string, overruled_because string, waiver string, adjudication_fingerprint string"
SOURCE_MAP = "raw_path string, raw_sha256 string, normalized_path string, normalized_lines string, text_sha256 string, converter string, converter_version string, converter_options_digest string, page string, bbox string, converter_ref string"
SPAN_CLASSES = ("covered", "reviewed_empty", "dropped")
EXECUTION = ("model", "provider", "temperature", "seed")


class Bundle:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- tables

    def concepts(self, drafts: bool = False, proposals: bool = False) -> DataFrame:
        return B.read_bundle(self.spark, self.root, drafts, proposals)

    def meta(self, name: str) -> dict:
        """A document's frontmatter under meta/, empty where there is none."""
        text = store.read(self.spark, f"{self.root}/meta/{name}.md")
        return B.parse(text)[0] if text else {}

    def citations(self) -> DataFrame:
        return self.concepts().select("id", F.explode("sources").alias("source"))

    def log_rows(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/meta/{name}.jsonl"
        if store.read(self.spark, path) is None:
            return self.spark.createDataFrame([], f"ord int, {schema}")
        return B.read_log(self.spark, path, schema)

    def segments(self) -> DataFrame:
        rows = []
        for s in self.meta("extraction-plan").get("segments") or []:
            for f in s.get("files") or []:
                f = f if isinstance(f, dict) else {"path": f}
                span = f"#L{f['lines']}" if "lines" in f else f"#C{f['chars']}" if "chars" in f else ""
                rows.append((s["id"], str(s.get("status", "pending")), f["path"], f["path"] + span, f.get("tokens_est")))
        return self.spark.createDataFrame(rows, "segment string, status string, path string, span string, tokens_est long")

    # --- corpus

    def init(self, corpus_root: str, language: str = "en", write_policy: str = "proposals") -> None:
        if write_policy not in checks.WRITE_POLICIES:
            raise ValueError(f"unknown write policy: {write_policy}")
        today = datetime.date.today().isoformat()
        self._document("meta/purpose", {"type": "Meta", "title": "Purpose", "language": language, "write_policy": write_policy, "test_queries": []}, "")
        self._document("meta/corpus", {"type": "Meta", "title": "Corpus", "corpus": corpus_root, "extracted_at": today}, "")
        self.snapshot()

    def corpus(self) -> DataFrame:
        return B.read_corpus(self.spark, str(self.meta("corpus")["corpus"]))

    def survey(self) -> DataFrame:
        return corpus.survey(self.corpus().where("is_text"))

    def snapshot(self) -> None:
        """Record the corpus as it is: hashes of all files, as a table."""
        self.corpus().select("path", "sha256").write.mode("overwrite").parquet(f"{self.root}/.cache/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/.cache/manifest")

    def diff(self) -> DataFrame:
        return corpus.diff(self.manifest(), self.corpus())

    def update_plan(self) -> dict[str, DataFrame]:
        drift, cites = self.diff(), self.citations()
        return {"affected": corpus.affected(cites, drift), "uncovered_new": corpus.uncovered_new(drift, cites), "stale_candidates": corpus.stale_candidates(cites, drift)}

    def segment(self, budget: int = 50_000, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
        own = corpus.scoped(self.corpus().where("is_text AND NOT excluded"), include, exclude)
        return corpus.pack(corpus.chunk_files(own, budget).withColumn("corpus", F.lit("corpus")), budget)

    def glean(self) -> DataFrame:
        return corpus.glean(self.segments(), self.citations())

    # --- retrieval

    def lexicon(self) -> list[dict]:
        return list(self.meta("lexicon").get("rows") or [])

    def query(self, text: str, n: int = 10, expand: bool = True, **filters) -> tuple[DataFrame, retrieval.Expansion]:
        return retrieval.query(self.index(), self.lexicon(), text, n, expand, **filters)

    def index(self) -> retrieval.Index:
        """The index of the bundle as it is; one that is stored under .cache is used while the bundle's files are the same."""
        c = self.concepts()
        state = c.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "sha256"))), "\n").cast("binary"), 256)).first()[0]
        home = f"{self.root}/.cache/index"
        known = store.read(self.spark, f"{home}/state.json")
        if known != T.canonical({"rules": RULES_VERSION, "state": state}):
            own = retrieval.index(c, save=False)
            own.postings.write.mode("overwrite").parquet(f"{home}/postings")
            own.docs.write.mode("overwrite").parquet(f"{home}/docs")
            store.write(self.spark, f"{home}/state.json", T.canonical({"rules": RULES_VERSION, "state": state}))
        return retrieval.Index(self.spark.read.parquet(f"{home}/docs"), self.spark.read.parquet(f"{home}/postings"))

    def show(self, cid: str, section: str | None = None, most: int | None = None) -> str:
        if ".." in cid.split("/") or cid.startswith("/"):
            raise KeyError(cid)
        text = store.read(self.spark, f"{self.root}/{cid}.md")
        if text is None:
            raise KeyError(f"no such concept: {cid}")
        own = self.spark.createDataFrame([(text,)], "t string")
        if section is not None:
            text = own.select(T.section(F.col("t"), section)).first()[0]
            if text is None:
                raise KeyError(f"no such section: {section}")
        return text if most is None or len(text) <= most else text[:most] + "\n[truncated]"

    def links(self) -> DataFrame:
        c = self.concepts()
        return retrieval.link_lists(retrieval.edges(c), c)

    # --- curation

    def clusters(self) -> DataFrame:
        return curation.cluster(self.concepts(drafts=True).where("kind = 'draft'"))

    def sample(self, fraction: float = 0.1, minimum: int = 20, seed: str = "no-seed") -> DataFrame:
        finals = self.concepts().where("kind = 'final'")
        n = finals.count()
        target = min(n, max(minimum, -int(-n * fraction // 1)))
        return curation.review_sample(curation.risk_tags(finals, self.citations(), None), seed, target)

    def repair_links(self) -> DataFrame:
        c = self.concepts()
        return curation.repair(curation.dangling(retrieval.edges(c), c), c)

    def merge_audit(self) -> DataFrame:
        groups = curation.merge_groups(self.log_rows("ledger", LEDGER).where("merge_map IS NOT NULL"))
        c = self.concepts(drafts=True)
        values = lambda col: c.select("id", F.explode(col).alias("value")).distinct()
        cites = values(F.transform("sources", T.source_path))
        links = retrieval.edges(c).select(F.col("src").alias("id"), F.col("dst").alias("value")).join(c.select(F.col("id").alias("value")), "value", "left_semi").select("id", "value").distinct()
        dates = values(F.flatten(F.transform(F.map_values(F.map_filter("meta", lambda k, v: ~k.isin("sources", "aliases"))), T.literals)))
        enums = c.select("id", F.explode(F.map_filter("meta", lambda k, v: k.isin("status", "authority", "jurisdiction", "confidence"))).alias("field", "value"))
        return reports.audit(groups, (cites, cites), (links, links), (dates, dates), (enums, enums))

    # --- checks

    def validate(self, rules: dict | None = None, strict: bool = False) -> DataFrame:
        c, cites = self.concepts(), self.citations()
        edges = retrieval.edges(c)
        parts = [
            checks.conformance(c), checks.required_meta(c), checks.write_policy(c), checks.id_collisions(c), checks.stale_fields(c),
            checks.missing_sources(c), checks.dangling(edges, c), checks.orphans(edges, c, strict=strict),
            checks.injection(c.select("path", F.col("body").alias("text")), strict),
        ]
        if self.meta("corpus"):
            parts += [checks.source_existence(cites, self.manifest(), strict), checks.anchors(cites, self.corpus().where("is_text"), strict)]
        if rules:
            parts.append(checks.archetype(c, rules))
        if self.lexicon():
            parts.append(checks.lexicon(retrieval.lexicon_table(self.spark, self.lexicon()), c))
        if self.meta("extraction-plan"):
            if self.meta("corpus"):
                parts.append(checks.outside_scope(cites, self.segments(), self.manifest()))
            parts.append(checks.provenance(self.job_marks(), self.log_rows("ledger", LEDGER), strict))
        purpose = self.meta("purpose")
        own = checks.acceptance(purpose.get("acceptance"), len(purpose.get("test_queries") or []), len(purpose.get("adversarial_queries") or []))
        parts.append(self.spark.createDataFrame([("error", code, "meta/purpose", m) for code, m in own], "level string, code string, path string, message string"))
        return checks.union(*parts)

    def release_check(self, rules: dict | None = None) -> DataFrame:
        found = reports.injection(self.concepts().select("path", F.col("body").alias("text")))
        hatch = bool((self.meta("purpose").get("acceptance") or {}).get("allow_injection"))
        purpose, ledger = self.meta("purpose"), self.log_rows("ledger", LEDGER + ", spans map<string,map<string,string>>")
        parts = [release.validated(self.validate(rules, strict=True)), release.injection_free(found, hatch)]
        if str(purpose.get("provenance", "")).strip() != "legacy":
            segments = self.segments()
            spans = curation.latest_spans(ledger).select("segment", F.explode("spans").alias("class", "own"))
            # a report without spans is one as well
            latest = spans.select("segment", "class", F.explode_outer("own").alias("span", "why")).where("class != 'dropped' OR span IS NOT NULL").drop("why")
            reported = curation.latest_spans(ledger).select("segment", F.lit("reported").alias("class"), F.lit("").alias("span"))
            none = segments.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
            parts += [release.problem(none, "E_REL_SEGMENTS", F.lit("no plan")), release.provenance_complete(segments, self.jobs(), ledger), release.spans_reported(segments, latest.unionByName(reported))]
        asked = [(q["query"] if isinstance(q, dict) else str(q),) for q in purpose.get("test_queries") or []]
        acceptance = purpose.get("acceptance") or {}
        parts.append(release.surface(self.spark.createDataFrame(asked, "query string"), 10, "E_REL_EVAL_SURFACE"))
        one = self.spark.range(1)
        if store.read(self.spark, f"{self.root}/meta/eval.json") is None:
            parts.append(release.problem(one, "E_REL_EVAL_MISSING", F.lit("acceptance")))
        if acceptance.get("dissent") == "required":
            none = curation.merge_groups(ledger.where("merge_map IS NOT NULL")).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
            parts.append(release.problem(none, "E_REL_DISSENT_UNVERIFIABLE", F.lit("no merge group")))
            parts.append(release.dissent(self.dissent_states(ledger), bool(acceptance.get("allow_open_dissent"))))
        return release.verdict(*parts)

    def jobs(self) -> DataFrame:
        """segment, digest: the frozen job of each planned segment."""
        names = {r.segment for r in self.segments().select("segment").distinct().collect()}
        texts = {n: store.read(self.spark, f"{self.root}/meta/jobs/{n}.json") for n in sorted(names)}
        return self.spark.createDataFrame([(n, json.loads(t)["digest"]) for n, t in texts.items() if t], "segment string, digest string")

    def job_marks(self) -> DataFrame:
        """segment, digest, recomputed, prompt_sha256, prompt_now: what the frozen jobs say and what holds now."""
        rows = []
        for r in self.jobs().collect():  # a small file a planned segment
            job = json.loads(store.read(self.spark, f"{self.root}/meta/jobs/{r.segment}.json"))
            prompt = store.read(self.spark, f"{self.root}/{job['prompt_path']}")
            again = T.digest({k: v for k, v in job.items() if k != "digest"}, compact=True)
            rows.append((r.segment, job["digest"], again, job["prompt_sha256"], None if prompt is None else hashlib.sha256(prompt.encode()).hexdigest()))
        return self.spark.createDataFrame(rows, "segment string, digest string, recomputed string, prompt_sha256 string, prompt_now string")

    def dissent_states(self, ledger: DataFrame) -> DataFrame:
        """group, state: whether each merged group's adjudication holds."""
        groups = curation.merge_groups(ledger.where("merge_map IS NOT NULL"))
        marks = [(r.final, self._group_mark(r.final, r.drafts)) for r in groups.collect()]
        return curation.dissent_state(self.log_rows("dissent", DISSENT), self.spark.createDataFrame(marks, "group string, current string"))

    def _group_mark(self, group: str, drafts: list[str]) -> str:
        final = store.read(self.spark, f"{self.root}/{group}.md")
        return T.digest({"drafts": sorted(drafts), "final": hashlib.sha256(final.encode()).hexdigest() if final else ""})

    def budget(self) -> DataFrame:
        return reports.budget(self.concepts().where("kind != 'meta'").select("id", "type", T.token_count(F.col("body")).alias("tokens")))

    def injection(self) -> DataFrame:
        return reports.injection(self.concepts().select("path", F.col("body").alias("text")))

    def source_map(self) -> DataFrame:
        """Rows of the source map with their state: error, verified or drift."""
        rows = self.log_rows("source-map", SOURCE_MAP)
        files = self.corpus().where("is_text").select(F.col("path").alias("normalized_path"), "text")
        first = F.regexp_extract("normalized_lines", r"^L(\d+)(?:-L(\d+))?$", 1)
        last = F.regexp_extract("normalized_lines", r"^L(\d+)(?:-L(\d+))?$", 2)
        a = F.when(first != "", first.cast("int"))
        b = F.when(last != "", last.cast("int")).otherwise(a)
        met = rows.join(files, "normalized_path", "left")
        lines = F.size(F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)))
        blank = F.exists(F.array("raw_path", "raw_sha256", "text_sha256", "converter", "converter_version", "converter_options_digest"), lambda x: F.trim(F.coalesce(x, F.lit(""))) == "")
        state = F.when(blank, "E_SOURCEMAP_FIELD").when(a.isNull() | (a < 1) | (b < a), "E_SOURCEMAP_LINES").when(F.col("text").isNull(), "E_SOURCEMAP_NO_FILE").when(b > lines, "E_SOURCEMAP_LINES")
        state = state.when(F.sha2(T.line_span(F.col("text"), a, b).cast("binary"), 256) != F.col("text_sha256"), "E_SOURCEMAP_TEXT_DRIFT").otherwise("verified")
        return met.select("ord", "normalized_path", "normalized_lines", state.alias("state"))

    # --- writes

    def _document(self, cid: str, meta: dict, body: str) -> None:
        store.write(self.spark, f"{self.root}/{cid}.md", B.serialise(meta, body))

    def package(self) -> str:
        """Write the index and the record of what it was made of; the fingerprint."""
        c = self.concepts()
        parts = [r.section for r in B.index_markdown(c).orderBy("type").toLocalIterator()]
        store.write(self.spark, f"{self.root}/index.md", "# Index\n\n" + "\n".join(parts))
        finals = c.where("kind = 'final'").select(F.lit(1).alias("g"), "id", "sha256")
        row = curation.fingerprint(finals, ["g"]).first()
        mark = row.fingerprint if row else hashlib.sha256(b"").hexdigest()
        store.write(self.spark, f"{self.root}/meta/package.json", T.canonical({"fingerprint": mark, "rules": RULES_VERSION}))
        return mark

    def log(self, message: str, day: str | None = None) -> None:
        """Add a line under the day's heading; days and lines newest first."""
        day = day or datetime.date.today().isoformat()
        text = store.read(self.spark, f"{self.root}/log.md") or "# Log\n"
        head = f"## {day}\n\n"
        if head in text:
            text = text.replace(head, f"{head}- {message}\n", 1)
        else:
            top, _, rest = text.partition("\n")
            text = f"{top}\n\n{head}- {message}\n{rest if rest.startswith(chr(10)) else chr(10) + rest if rest else ''}"
        store.write(self.spark, f"{self.root}/log.md", text)

    def propose(self, target: str, action: str, content: str = "", note: str = "") -> str:
        if action not in ("create", "update", "delete") or (action != "delete" and not content):
            raise ValueError("a proposal creates, updates or deletes, and has content unless it deletes")
        name = self.spark.createDataFrame([(target,)], "t string").select(T.kebab(F.col("t"))).first()[0]
        self._document(f"proposals/{name}", {"type": "Proposal", "title": note or target, "target": target, "action": action, "note": note}, content)
        return f"proposals/{name}"

    def accept(self, proposal: str) -> None:
        meta, body = B.parse(store.read(self.spark, f"{self.root}/{proposal}.md") or "")
        where = f"{self.root}/{meta['target']}.md"
        there = store.read(self.spark, where) is not None
        if there == (meta["action"] == "create"):
            raise ValueError(f"{meta['action']} of {meta['target']}: it {'exists' if there else 'does not exist'}")
        if meta["action"] == "delete":
            store.delete(self.spark, where)
        else:
            B.parse(body)  # must be a concept
            store.write(self.spark, where, body)
        self.reject(proposal)

    def reject(self, proposal: str) -> None:
        store.delete(self.spark, f"{self.root}/{proposal}.md")

    def stale(self, cid: str, reason: str | None) -> None:
        """Mark a concept stale for a reason, or clear it without one."""
        meta, body = B.parse(self.show(cid))
        meta = {k: v for k, v in meta.items() if k not in ("stale", "stale_reason", "stale_since")}
        if reason:
            meta |= {"stale": True, "stale_reason": reason, "stale_since": datetime.date.today().isoformat()}
        self._document(cid, meta, body)

    def ledger_add(self, run_id: str, segment: str, inputs: list[str], outputs: list[str], prompt_version: str, merge_map: dict | None = None, job_digest: str | None = None, spans: dict | None = None) -> None:
        if spans is not None and (job_digest is None or set(spans) - set(SPAN_CLASSES)):
            raise ValueError("span outcomes need a job and known classes")
        known = {r.path: r.sha256 for r in self.manifest().where(F.col("path").isin(inputs)).collect()} if inputs else {}
        row = {"run_id": run_id, "segment": segment, "inputs": inputs, "input_hashes": {i: known.get(i, "unknown") for i in inputs}, "prompt_version": prompt_version, "outputs": outputs}
        row |= {k: v for k, v in (("merge_map", merge_map), ("job_digest", job_digest), ("spans", spans)) if v is not None}
        B.append_log(self.spark, f"{self.root}/meta/ledger.jsonl", [row])

    def dissent_add(self, group: str, drafts: list[str], verdict: str, run_id: str, waiver: str | None = None) -> None:
        mark = self._group_mark(group, drafts)
        row = {"run_id": run_id, "group": group, "drafts": drafts, "verdict": verdict, "adjudication_fingerprint": mark} | ({"waiver": waiver} if waiver else {})
        B.append_log(self.spark, f"{self.root}/meta/dissent.jsonl", [row])

    def freeze_job(self, segment: str, prompt: str, execution: dict | None = None) -> dict:
        """The job of a segment: its inputs and prompt by hash, and a digest of all that."""
        if execution and set(execution) - set(EXECUTION):
            raise ValueError(f"unknown execution fields: {sorted(set(execution) - set(EXECUTION))}")
        spans = [r.span for r in self.segments().where(F.col("segment") == segment).collect()]
        hashes = {r.path: r.sha256 for r in self.manifest().join(self.segments().where(F.col("segment") == segment).select("path").distinct(), "path", "left_semi").collect()}
        mark = hashlib.sha256(prompt.encode()).hexdigest()
        store.write(self.spark, f"{self.root}/meta/prompts/{mark}.txt", prompt)
        job = {"schema": "job@1", "segment": segment, "inputs": [{"span": s, "sha256": hashes.get(s.partition("#")[0])} for s in spans], "prompt_path": f"meta/prompts/{mark}.txt", "prompt_sha256": mark}
        job |= {"execution": execution} if execution else {}
        job["digest"] = T.digest(job, compact=True)
        store.write(self.spark, f"{self.root}/meta/jobs/{segment}.json", json.dumps(job, ensure_ascii=False, indent=2))
        return job

    def eval_run(self, n: int = 10, suite: str = "acceptance") -> DataFrame:
        """qid, rank, id, via, score for every question of the suite, in one plan; pins are those of its expansion."""
        if n < 1:
            raise ValueError("n must be at least 1")
        asked = self.meta("purpose").get("test_queries" if suite == "acceptance" else "adversarial_queries") or []
        texts = [q["query"] if isinstance(q, dict) else q for q in asked]
        queries = retrieval.ask(self.spark, dict(enumerate(texts)))
        return retrieval.searched(retrieval.pool(self.index()), retrieval.expanded(retrieval.lexicon_table(self.spark, self.lexicon()), queries), n)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy text files as they are to ``target``; a source-map row each. Options have a digest, here of none."""
    files = B.read_corpus(spark, source).where("is_text AND ext IN ('.md', '.markdown', '.txt')")
    options = T.digest({})[:32]
    for r in files.select("path", "text").toLocalIterator():
        store.write(spark, f"{target.rstrip('/')}/{r.path}", r.text)
    lines = F.size(F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)))
    return files.select(
        F.col("path").alias("raw_path"), F.col("sha256").alias("raw_sha256"), F.col("path").alias("normalized_path"), F.concat(F.lit("L1-L"), lines.cast("string")).alias("normalized_lines"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.lit("passthrough").alias("converter"), F.lit("1").alias("converter_version"), F.lit(options).alias("converter_options_digest"),
    )


def workspace_members(spark: SparkSession, path: str) -> list[dict]:
    """name, path, role of each member of a workspace."""
    text = store.read(spark, path) or ""
    rows = B.parse(text)[0].get("members") or []
    bad = [r for r in rows if r.get("role") not in ("knowledge", "constraints")]
    if bad:
        raise ValueError(f"unknown role: {bad[0].get('role')}")
    return rows


__all__ = ["Bundle", "normalise", "workspace_members"]
