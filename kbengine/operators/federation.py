"""Federated search: same-as classes, rank fusion, merging, pulled constraints, crosswalk candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .graph import components, stored
from .retrieval import Index, scores
from .similar import similar_names, tasks

RRF = 60


def active(crosswalk: DataFrame, changed: DataFrame, unverifiable: DataFrame) -> DataFrame:
    """Accepted rows that touch no changed concept (ref) and no unverifiable member."""
    rows = crosswalk.where(F.col("status") == "accepted")
    for side in ("src", "dst"):
        rows = rows.join(changed.select(F.col("ref").alias(side)), side, "left_anti")
        rows = rows.withColumn("member", T.parse_ref(F.col(side))[0]).join(unverifiable.select("member"), "member", "left_anti").drop("member")
    return rows


def same_as(crosswalk: DataFrame) -> DataFrame:
    """node, root: least ref of each same-as class."""
    return components(crosswalk.where(F.col("rel") == "same-as").select(F.col("src").alias("a"), F.col("dst").alias("b")))


def name_tokens(concepts: DataFrame) -> DataFrame:
    return concepts.select("ref", F.array_distinct(F.concat(T.tokenize(F.col("title")), T.tokenize(T.joined(F.col("aliases"))))).alias("names"))


def expansion_terms(crosswalk: DataFrame, concepts: DataFrame, member: str, terms: list[str]) -> DataFrame:
    """term: near-side name tokens of active same-as rows whose far side shares a name token with the query; sorted."""
    rows = crosswalk.where((F.col("rel") == "same-as") & (F.col("status") == "accepted"))
    sides = rows.select(F.col("src").alias("near"), F.col("dst").alias("far")).unionByName(rows.select(F.col("dst").alias("near"), F.col("src").alias("far")))
    sides = sides.where(T.parse_ref(F.col("near"))[0] == member)
    names = name_tokens(concepts)
    own = sides.join(names.select(F.col("ref").alias("far"), F.col("names").alias("theirs")), "far").join(names.select(F.col("ref").alias("near"), "names"), "near")
    asked = F.array(*map(F.lit, terms)).cast("array<string>")
    return own.where(F.arrays_overlap("theirs", asked)).select(F.explode(F.array_except("names", asked)).alias("term")).distinct().orderBy("term")


def member_ranks(indexes: Index, queries: DataFrame, n: int) -> DataFrame:
    """qid, member, ref, rank (0-based), rrf: BM25 within each member, whose statistics are its own.

    The index has member and ref beside the concepts' ids. All members are scored
    in one plan: a member is part of the query's key, and of the terms where
    ``queries`` has a member. Where it has ``pins`` as well, ids of the member's, these
    come first, and BM25 ranks the rest.
    """
    ranks = Window.partitionBy("qid", "member")
    if "pins" in queries.columns:
        pins = queries.select("qid", "member", F.posexplode("pins").alias("k", "id"))
        fixed = pins.join(indexes.docs.select("id", "member"), ["id", "member"], "left_semi")
        fixed = fixed.groupBy("qid", "member", "id").agg(F.min("k").alias("k"))
        total = scores(indexes, queries, ("member",), fixed.select("qid", "id"))
        places = total.select("qid", "member", "id", F.lit(1).alias("tier"), F.row_number().over(ranks.orderBy(F.desc(F.round("score", 9)), "ord")).alias("k"))
        both = places.unionByName(fixed.withColumn("tier", F.lit(0)))
        best = both.withColumn("rank", F.row_number().over(ranks.orderBy("tier", "k")) - 1).where(F.col("rank") < n).drop("tier", "k")
    else:
        total = scores(indexes, queries, ("member",))
        best = total.withColumn("rank", F.row_number().over(ranks.orderBy(F.desc(F.round("score", 9)), "ord")) - 1).where(F.col("rank") < n)
    return best.join(indexes.docs.select("id", "ref"), "id").select("qid", "member", "ref", "rank", (1.0 / (RRF + F.col("rank") + 1)).alias("rrf"))


def merge(ranked: DataFrame, roots: DataFrame, roles: DataFrame) -> DataFrame:
    """qid, role, ref, score, duplicates: the members of a same-as class and role are one hit, its best ref in front."""
    own = ranked.join(roots.select(F.col("node").alias("ref"), "root"), "ref", "left").join(roles, "member").withColumn("root", F.coalesce("root", "ref"))
    best = own.groupBy("qid", "role", "root").agg(F.sum("rrf").alias("score"), F.min(F.struct(F.round(-F.col("rrf"), 12).alias("k"), "ref")).alias("b"), F.collect_set("ref").alias("refs"))
    return best.select("qid", "role", F.col("b.ref").alias("ref"), "score", F.array_sort(F.array_remove("refs", F.col("b.ref"))).alias("duplicates"), "root")


def split(merged: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid", "role").orderBy(F.desc(F.round("score", 12)), "ref"))
    return merged.withColumn("place", place).where(F.col("place") <= n)


def pulled(top: DataFrame, roots: DataFrame, crosswalk: DataFrame, n: int = 5) -> DataFrame:
    """qid, ref: constraints bound to any ref of the classes of the first ``n`` knowledge hits."""
    hits = top.where((F.col("role") == "knowledge") & (F.col("place") <= n)).select("qid", "root")
    members = roots.select(F.col("node").alias("dst"), "root")
    dst = hits.join(members, "root").select("qid", "dst").unionByName(hits.select("qid", F.col("root").alias("dst"))).distinct()
    rows = crosswalk.where((F.col("rel") == "constrains") & (F.col("status") == "accepted"))
    return dst.join(rows, "dst").select("qid", F.col("src").alias("ref")).distinct()


def norms(concepts: DataFrame, *more: str) -> DataFrame:
    """member, ref, norm, and ``more``: normalised names of title and aliases."""
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    own = concepts.select("member", "ref", *more, F.explode(F.array_distinct(F.transform(names, lambda x: F.array_join(T.tokenize(x), " ")))).alias("norm"))
    return own.where("norm != ''")


def _finals(concepts: DataFrame, roster: list[str] | None) -> DataFrame:
    """Concepts outside meta/ with the place of their member in the roster, or by its name."""
    own = concepts.where(~T.parse_ref(F.col("ref"))[1].startswith("meta/"))
    place = F.array_position(F.array(*map(F.lit, roster)), F.col("member")) if roster else F.dense_rank().over(Window.orderBy("member"))
    places = own.select("member").distinct().withColumn("place", place)  # a row a member
    return own.join(F.broadcast(places), "member")


#: Refs of one name and member at most that meet others in one row of work.
GROUP = 512


def _groups(named: DataFrame) -> DataFrame:
    """name, place, part, items: refs with what else is beside them, in groups of about ``GROUP``."""
    often = named.groupBy("name", "place").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    part = F.pmod(F.xxhash64("ref"), F.col("parts")).alias("part")
    return named.join(often, ["name", "place"]).groupBy("name", "place", part).agg(F.collect_list(F.struct("ref", "norms")).alias("items"))


def _expanded(met: DataFrame) -> DataFrame:
    """a, b: every ref of the one group with every one of the other; groups are dealt out anew, so that no name is one task's."""
    dealt = met.repartition(tasks(met), "x.name", "x.place", "x.part", "y.name", "y.place", "y.part")
    one = dealt.select(F.col("x.name").alias("x"), F.col("y.name").alias("y"), F.explode("x.items").alias("a"), F.col("y.items").alias("items"))
    return one.select("x", "y", "a", F.explode("items").alias("b"))


def candidates_exact(concepts: DataFrame, roster: list[str] | None = None) -> DataFrame:
    """src, dst: concepts of two members (in roster order) that share a normalised name."""
    own = norms(_finals(concepts, roster), "place").groupBy("place", "ref").agg(F.collect_set("norm").alias("norms"))
    # two that share several names meet under the least of them; most have one only, and need no list
    groups = _groups(own.select("place", "ref", F.when(F.size("norms") > 1, F.col("norms")).alias("norms"), F.explode("norms").alias("name")))
    met = groups.alias("x").join(groups.alias("y"), F.expr("x.name = y.name AND x.place < y.place"))
    once = F.col("a.norms").isNull() | F.col("b.norms").isNull() | (F.array_min(F.array_intersect("a.norms", "b.norms")) == F.col("x"))
    return _expanded(met).where(once).select(F.col("a.ref").alias("src"), F.col("b.ref").alias("dst"))


def candidates_fuzzy(concepts: DataFrame, least: float = 0.85, roster: list[str] | None = None) -> DataFrame:
    """src, dst: other pairs of two members, in roster order, whose titles' joined tokens are similar; none is lost."""
    finals = _finals(concepts, roster).select("member", "ref", "place", "title", "aliases")
    names = norms(finals.where(F.size("aliases") > 0)).groupBy("ref").agg(F.collect_set("norm").alias("norms"))
    own = finals.select("ref", "place", F.array_join(T.tokenize(F.col("title")), " ").alias("name")).where("name != ''").join(names, "ref", "left")
    own = stored(own, "names")
    groups = _groups(own)
    near = similar_names(own, own, least)
    met = near.join(groups.alias("x"), F.expr("a = x.name")).join(groups.alias("y"), F.expr("b = y.name AND x.place < y.place"))
    norms_of = lambda c, name: F.coalesce(f"{c}.norms", F.array(name))
    exact = (F.col("a.norms").isNotNull() | F.col("b.norms").isNotNull()) & F.arrays_overlap(norms_of("a", "x"), norms_of("b", "y"))
    return _expanded(met).where(~exact).select(F.col("a.ref").alias("src"), F.col("b.ref").alias("dst"))
