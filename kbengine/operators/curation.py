"""Curation: clusters of drafts, review samples, link repair, merge audit, dissent, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .graph import components
from .similar import similar_names


def cluster_edges(drafts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """a, b: drafts of one type whose titles are alike, or one of which names the other in an alias.

    Pairs meet on a shared title token or an equal whole name: a similarity over
    the threshold needs one, so no other pair is looked at. Equal names link to
    the least draft that has them, which keeps large groups linear.
    """
    keys = drafts.select(
        "id", F.coalesce("type", F.lit("\0none")).alias("type"),
        F.array_sort(F.array_distinct(T.tokenize(F.col("title")))).alias("tokens"),
        F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.array_sort(F.array_distinct(T.tokenize(a)))), lambda k: F.size(k) > 0).alias("names"),
    )
    titles = keys.groupBy("type", "tokens").agg(F.min("id").alias("a"))
    equal = keys.join(titles, ["type", "tokens"]).where("id != a").select("a", F.col("id").alias("b"))
    named = keys.select("id", "type", F.explode("names").alias("tokens")).join(titles, ["type", "tokens"]).where("id != a").select("a", F.col("id").alias("b"))
    # one row a distinct title from here; the rest follow by equality. A pair over the threshold shares a
    # token among the first ones in order of rarity (prefix filter), so common tokens form no blocks.
    each = titles.where(F.size("tokens") > 0).select("type", "tokens", "a")
    token = each.select("type", "a", "tokens", F.explode("tokens").alias("token"))
    often = token.groupBy("type", "token").agg(F.count(F.lit(1)).alias("often"))
    ranked = token.join(often, ["type", "token"]).withColumn("k", F.row_number().over(Window.partitionBy("type", "a").orderBy("often", "token")))
    prefix = ranked.where(F.col("k") <= F.size("tokens") - F.ceil(threshold * F.size("tokens")) + 1).select("type", "token", "a", "tokens")
    other = prefix.select("type", "token", F.col("a").alias("b"), F.col("tokens").alias("theirs"))
    near = prefix.join(other, ["type", "token"]).where("a < b").where(T.jaccard(F.col("tokens"), F.col("theirs")) >= threshold).select("a", "b").distinct()
    return equal.unionByName(named).unionByName(near).distinct()


def cluster(drafts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """root, ids: groups of drafts, lone ones included."""
    own = components(cluster_edges(drafts, threshold), drafts.select(F.col("id").alias("node")))
    return own.groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("ids"))


def risk_tags(concepts: DataFrame, citations: DataFrame, drift: DataFrame | None) -> DataFrame:
    """id, type, tags: why a concept needs review."""
    paths = citations.select("id", T.source_path(F.col("source")).alias("path"))
    weak = paths.groupBy("id").agg(F.countDistinct("path").alias("paths"))
    rare = concepts.groupBy("type").agg(F.count(F.lit(1)).alias("of_type"))
    own = concepts.select("id", "type", "stale").join(weak, "id", "left").join(rare.withColumnRenamed("type", "own"), F.col("type").eqNullSafe(F.col("own")))
    if drift is not None:
        hit = paths.join(drift.where(F.col("change").isin("changed", "removed")).select("path"), "path").select("id").distinct().withColumn("hit", F.lit(True))
        own = own.join(hit, "id", "left")
    else:
        own = own.withColumn("hit", F.lit(None).cast("boolean"))
    tags = F.array_compact(F.array(
        F.when(F.col("hit"), "changed-source"), F.when(F.col("stale"), "stale"),
        F.when(F.coalesce("paths", F.lit(0)) <= 1, "weak-coverage"), F.when(F.col("of_type") <= 2, "rare-type"),
    ))
    return own.select("id", "type", tags.alias("tags"))


def hashed(seed: str, of: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), of), 256)


def review_sample(tagged: DataFrame, seed: str, target: int) -> DataFrame:
    """id, tier: risk first, then types in turn, then one of each type that is still missing."""
    own = tagged.withColumns({"r": hashed(seed, F.col("id")), "rt": hashed(seed, F.col("type"))})
    risk = own.where(F.size("tags") > 0).orderBy(F.desc(F.size("tags")), "r").limit(target)
    taken = risk.agg(F.count(F.lit(1)).alias("taken"))
    rest = own.join(risk.select("id"), "id", "left_anti").withColumn("round", F.row_number().over(Window.partitionBy("type").orderBy("r")))
    rest = rest.withColumn("k", F.row_number().over(Window.orderBy("round", "rt", "r"))).crossJoin(F.broadcast(taken))  # taken is one row
    fill = rest.where(F.col("k") <= F.lit(target) - F.col("taken"))
    picked = risk.select("id", "type", F.lit("risk").alias("tier")).unionByName(fill.select("id", "type", F.lit("fill").alias("tier")))
    unseen = own.join(picked.select("type").distinct(), "type", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("r"))).where("k = 1")
    return picked.unionByName(unseen.select("id", "type", F.lit("type-coverage").alias("tier")))


def dangling(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Resolved links to no concept, each occurrence."""
    return edges.where(F.col("dst").isNotNull()).join(concepts.select(F.col("id").alias("dst")), "dst", "left_anti")


def orphans(edges: DataFrame, concepts: DataFrame, index_targets: DataFrame | None = None) -> DataFrame:
    """Finals that neither the index nor any concept links to."""
    reached = edges.where(F.col("dst").isNotNull()).select(F.col("dst").alias("id"))
    if index_targets is not None:
        reached = reached.unionByName(index_targets.select("id"))
    return concepts.where(~F.col("id").startswith("meta/")).select("id").join(reached.distinct(), "id", "left_anti")


def basename(concept: Column) -> Column:
    return F.substring_index(concept, "/", -1)


def repair(dangling_: DataFrame, concepts: DataFrame, least: float = 0.85) -> DataFrame:
    """src, pos, dst, suggestion, outcome: a unique equal basename, else a unique similar one, else ambiguous or unresolved."""
    names = concepts.select(basename(F.col("id")).alias("name"), "id").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    own = dangling_.withColumn("name", basename(F.col("dst"))).join(names, "name", "left")
    exact = own.where("n = 1").select("src", "pos", "dst", F.col("only").alias("suggestion"), F.lit("exact").alias("outcome"))
    clash = own.where("n > 1").select("src", "pos", "dst", F.lit(None).cast("string").alias("suggestion"), F.lit("ambiguous").alias("outcome"))
    near = similar_names(own.where("n IS NULL").select("name"), names.select("name"), least)
    close = near.join(names.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("m"), F.min("only").alias("close"))
    rest = own.where("n IS NULL").select("src", "pos", "dst", "name").join(close, "name", "left")
    fuzzy = rest.select("src", "pos", "dst", F.when(F.col("m") == 1, F.col("close")).alias("suggestion"), F.when(F.col("m") == 1, "fuzzy").when(F.col("m") > 1, "ambiguous").otherwise("unresolved").alias("outcome"))
    return exact.unionByName(clash).unionByName(fuzzy)


def merge_groups(ledger: DataFrame) -> DataFrame:
    """final, drafts: by the last row that maps each draft; groups of two or more. ``ledger`` has ord and merge_map."""
    rows = ledger.select("ord", F.explode("merge_map").alias("draft", "final"))
    last = rows.groupBy("draft").agg(F.max_by("final", "ord").alias("final"))
    return last.groupBy("final").agg(F.array_sort(F.collect_list("draft")).alias("drafts")).where(F.size("drafts") >= 2)


def lost(groups: DataFrame, of_drafts: DataFrame, of_finals: DataFrame) -> DataFrame:
    """final, draft, value: values of a group's drafts (id, value) that its final (id, value) lacks."""
    own = groups.select("final", F.explode("drafts").alias("draft")).join(of_drafts.select(F.col("id").alias("draft"), "value"), "draft")
    return own.join(of_finals.select(F.col("id").alias("final"), "value"), ["final", "value"], "left_anti").select("final", "draft", "value")


def latest_spans(ledger: DataFrame) -> DataFrame:
    """segment, spans: the last reported outcome of each segment."""
    return ledger.where(F.col("spans").isNotNull()).groupBy("segment").agg(F.max_by("spans", "ord").alias("spans"))


def dissent_state(rows: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """group, state of each adjudication. ``rows`` has group, ord, verdict, waiver, adjudication_fingerprint."""
    waived = F.col("waiver").isNotNull() & (F.col("waiver") != "")
    own = rows.groupBy("group").agg(
        F.max_by(F.when(waived, F.col("adjudication_fingerprint")), F.when(waived, F.col("ord"))).alias("waiver"),
        F.max(waived).alias("any_waiver"), F.max(F.col("verdict") == "split").alias("any_split"),
        F.max_by("adjudication_fingerprint", "ord").alias("last"),
    )
    same = lambda c: F.when(F.col(c) == F.col("current"), "closed").otherwise("stale")
    own = fingerprints.select("group", "current").join(own, "group", "left")
    state = F.when(F.col("any_waiver").isNull(), "unadjudicated").when(F.col("any_waiver"), same("waiver")).when(F.col("any_split"), "open").otherwise(same("last"))
    return own.select("group", state.alias("state"))


def fingerprint(rows: DataFrame, by: list[str]) -> DataFrame:
    """sha256 of the sorted ``id:sha256`` lines of each group. A package's list of ids is one value by definition."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(T.path_key(F.col("id")).alias("ord"), "id", "sha256"))), lambda x: F.concat(x["id"], F.lit(":"), x["sha256"])), "\n")
    return rows.groupBy(*by).agg(F.sha2(lines.cast("binary"), 256).alias("fingerprint"))
