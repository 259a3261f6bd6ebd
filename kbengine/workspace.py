"""A workspace's verbs: several bundles searched, compared and released as one.

A workspace is a folder with ``meta/workspace.md`` (members), ``links/*.md``
(crosswalk rows) and ``meta/lexicon.md``. What its members were when it was last pinned
is a table; links to what has changed since, or to a member without a pin, are inactive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Bundle, workspace_members
from .functions import text as T
from .operators import curation, federation, release, retrieval
from .sources import bundle as B
from .sources import store

RELATIONS = ("same-as", "constrains", "related")
STATUSES = ("accepted", "proposed")
CROSSWALK = "src string, rel string, dst string, status string, origin string"


def _in(member: str):
    """Makes an id a ref of the member's; refs stay."""
    return lambda p: F.when(p.contains(":"), p).otherwise(F.concat(F.lit(f"{member}:"), p))


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- tables

    def init(self, members: list[dict]) -> None:
        """Write the roster (name, path, role of each member) and pin the members as they are."""
        store.write(self.spark, f"{self.root}/meta/workspace.md", B.serialise({"type": "Workspace", "title": "Workspace", "members": members}, ""))
        workspace_members(self.spark, f"{self.root}/meta/workspace.md")  # refuses unknown roles
        self.pin()

    def roster(self) -> list[dict]:
        return workspace_members(self.spark, f"{self.root}/meta/workspace.md")

    def bundle(self, name: str) -> Bundle:
        for m in self.roster():
            if m["name"] == name:
                return Bundle(self.spark, m["path"])
        raise KeyError(f"unknown member: {name}")

    def document(self, name: str) -> dict:
        text = store.read(self.spark, f"{self.root}/meta/{name}.md")
        return B.parse(text)[0] if text else {}

    def members(self) -> DataFrame:
        return self.spark.createDataFrame([(m["name"], m["role"]) for m in self.roster()], "member string, role string")

    def concepts(self) -> DataFrame:
        """The concepts of all members, with member and ref; a concept's id is its ref, for ids repeat between members."""
        each = (Bundle(self.spark, m["path"]).concepts().withColumn("member", F.lit(m["name"])) for m in self.roster())
        return reduce(DataFrame.unionByName, each).withColumn("ref", F.concat_ws(":", "member", "id")).withColumn("id", F.col("ref"))

    def crosswalk(self) -> DataFrame:
        """All rows of links/*.md; the pages are small and reviewed."""
        pages = B.read_files(self.spark, self.root).where("path LIKE 'links/%.md'").select("path", F.col("content").cast("string").alias("text")).orderBy("path")
        rows = [r for p in pages.toLocalIterator() for r in B.parse(p.text)[0].get("rows") or []]
        return self.spark.createDataFrame([tuple(r.get(c) for c in ("src", "rel", "dst", "status", "origin")) for r in rows], CROSSWALK)

    # --- pins

    def _hashes(self) -> DataFrame:
        return self.concepts().where("kind = 'final'").select("member", "id", "sha256")

    def pin(self) -> None:
        self._hashes().write.mode("overwrite").parquet(f"{self.root}/.cache/pins")

    def pins(self) -> DataFrame:
        path = f"{self.root}/.cache/pins/_SUCCESS"
        if store.read(self.spark, path) is None:
            return self.spark.createDataFrame([], "member string, id string, sha256 string")
        return self.spark.read.parquet(f"{self.root}/.cache/pins")

    def changed(self) -> DataFrame:
        """ref: concepts of pinned members that were added, removed or changed since."""
        pins = self.pins()
        now = self._hashes().join(pins.select("member").distinct(), "member", "left_semi")
        both = now.select("id", "sha256").join(pins.select("id", F.col("sha256").alias("was")), "id", "full_outer")
        return both.where(~F.col("sha256").eqNullSafe(F.col("was"))).select(F.col("id").alias("ref"))

    def unverifiable(self) -> DataFrame:
        return self.members().select("member").join(self.pins().select("member"), "member", "left_anti")

    def active(self) -> DataFrame:
        return federation.active(self.crosswalk(), self.changed(), self.unverifiable()).select("src", "rel", "dst", "status", "origin")

    def status(self) -> DataFrame:
        """member, role, state (ok or no-pin), changed (how many concepts)."""
        n = self.changed().groupBy(T.parse_ref(F.col("ref"))[0].alias("member")).agg(F.count(F.lit(1)).alias("changed"))
        own = self.members().join(self.unverifiable().withColumn("none", F.lit(True)), "member", "left").join(n, "member", "left")
        return own.select("member", "role", F.when(F.col("none"), "no-pin").otherwise("ok").alias("state"), F.coalesce("changed", F.lit(0)).alias("changed"))

    # --- search

    def asked(self, text: str, crosswalk: DataFrame, concepts: DataFrame) -> DataFrame:
        """qid, member, terms, pins: what each member is asked, by its own lexicon, the workspace's and its same-as names."""
        query = retrieval.ask(self.spark, {0: text})
        words = list(query.first().terms)
        shared = list(self.document("lexicon").get("rows") or [])
        parts = []
        for m in self.roster():
            rows = retrieval.lexicon_table(self.spark, [*Bundle(self.spark, m["path"]).lexicon(), *shared])
            names = federation.expansion_terms(crosswalk, concepts, m["name"], words).agg(F.array_sort(F.collect_list("term")).alias("names")).withColumn("qid", F.lit(0).cast("long"))
            # a lexicon names a member's own concepts by id, the workspace's any by ref
            ref = F.transform("pins", _in(m["name"]))
            own = retrieval.expanded(rows, query).join(names, "qid")
            parts.append(own.select("qid", F.lit(m["name"]).alias("member"), F.concat("terms", "names").alias("terms"), ref.alias("pins")))
        return reduce(DataFrame.unionByName, parts)

    def query(self, text: str, n: int = 10, pull: int = 5) -> tuple[DataFrame, DataFrame]:
        """role, place, ref, score, duplicates: the best of each role; and ref: constraints that the first knowledge hits pull in."""
        concepts, crosswalk = self.concepts(), self.active()
        idx = retrieval.index(concepts.where(~T.parse_ref(F.col("ref"))[1].startswith("meta/")), "member", "ref")
        roots = federation.same_as(crosswalk)
        ranked = federation.member_ranks(idx, self.asked(text, crosswalk, concepts), n)
        top = federation.split(federation.merge(ranked, roots, self.members()), n)
        bound = federation.pulled(top, roots, crosswalk, pull).join(idx.docs.select("ref"), "ref", "left_semi").select("ref")
        return top.select("role", "place", "ref", "score", "duplicates"), bound

    def show(self, ref: str, section: str | None = None, most: int | None = None) -> str:
        member, colon, cid = ref.partition(":")
        if not colon:
            raise ValueError(f"no member in {ref!r}: member:concept is wanted")
        return self.bundle(member).show(cid, section, most)

    # --- crosswalk

    def link_candidates(self) -> DataFrame:
        """src, rel, dst, status, origin: equal names, accepted; similar titles, proposed."""
        own, names = self.concepts(), [m["name"] for m in self.roster()]
        row = lambda df, status, origin: df.select("src", F.lit("same-as").alias("rel"), "dst", F.lit(status).alias("status"), F.lit(origin).alias("origin"))
        return row(federation.candidates_exact(own, names), "accepted", "alias-exact").unionByName(row(federation.candidates_fuzzy(own, roster=names), "proposed", "candidate"))

    def link(self, a: str, b: str, rows: list[dict], note: str = "Reviewed links.\n") -> None:
        """Write the crosswalk page of two members."""
        for r in rows:
            if r["rel"] not in RELATIONS or r["status"] not in STATUSES or ":" not in r["src"] or ":" not in r["dst"]:
                raise ValueError(f"not a crosswalk row: {r}")
        lo, hi = sorted((a, b))
        store.write(self.spark, f"{self.root}/links/{lo}--{hi}.md", B.serialise({"type": "Crosswalk", "title": f"Crosswalk {lo} -- {hi}", "members": [lo, hi], "rows": rows}, note))

    # --- release

    def release_check(self) -> DataFrame:
        """ok, problems: members readable, accepted and as pinned, links active, acceptance questions there and evaluated."""
        state = []
        for m in self.roster():
            own = Bundle(self.spark, m["path"])
            readable = store.read(self.spark, f"{own.root}/meta/purpose.md") is not None
            state.append((m["name"], readable, readable and bool(own.release_check().first().ok)))
        marks = lambda df, name: curation.fingerprint(df, ["member"]).select("member", F.col("fingerprint").alias(name))
        pins = self.members().select("member").join(marks(self.pins(), "pinned"), "member", "left").join(marks(self._hashes(), "current"), "member", "left")
        accepted = self.spark.createDataFrame(state, "member string, readable boolean, accepted boolean")
        texts = [(q["query"] if isinstance(q, dict) else str(q),) for q in self.document("workspace").get("test_queries") or []]
        parts = [release.members(accepted, pins), release.crosswalk_fresh(self.crosswalk(), self.active()), release.surface(self.spark.createDataFrame(texts, "query string"), 10, "E_REL_WS_EVAL_SURFACE")]
        if store.read(self.spark, f"{self.root}/meta/eval.json") is None:
            parts.append(release.problem(self.spark.range(1), "E_REL_WS_EVAL_MISSING", F.lit("acceptance")))
        return release.verdict(*parts)


__all__ = ["Workspace"]
