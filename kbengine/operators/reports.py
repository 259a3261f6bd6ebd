"""Reports: budgets, the injection scan, cost of reading strategies, merge audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed patterns: a line is reported once for each rule that it meets. (?i) as the rules ignore case.
RULES = {
    "instruction-override": r"(?i)\b(?:ignore|disregard|forget|override)\s+(?:(?:all|any|the|your)\s+)?(?:previous|prior|earlier|above|preceding)\s+(?:instruction|prompt|rule|message|direction|constraint)s?\b|\bdisregard\s+(?:the\s+)?(?:system|developer)\s+(?:prompt|message|instruction)s?\b",
    "role-injection": r"(?i)^\s*(?:[-*>]\s*)?(?:system|developer|assistant)\s*:",
    "template-tag": r"(?i)<\s*/?\s*system\b[^>]*>|<\|\s*im_(?:start|end)\s*\|>|\[\s*/?\s*INST\s*\]",
    "identity-reassignment": r"(?i)\byou\s+are\s+now\s+(?:a|an|the)?\s*(?:[a-z][\w-]*\s+){0,2}(?:assistant|ai|model|agent|bot|chatbot|admin|administrator|root|developer|system|persona|dan|jailbroken|unrestricted|uncensored)\b|\bfrom\s+now\s+on,?\s+you\s+(?:are|will|must|should)\b|\byour\s+new\s+(?:role|instructions?|persona|identity)\b",
}
# Fixed parts of the exfiltration rule, each looked for on its own: that is linear in the line.
EXFILTRATE = r"(?i)\bexfiltrat(?:e|es|ed|ing|ion)\b"
OUTBOUND_ANY = r"(?i)\b(?:curl|wget|send|upload|transmit|email|beacon|post)\b"
OUTBOUND = r"(?i)\b(?:curl|wget|send|upload|transmit|email|beacon)\b"
STRONG = r"(?i)\.env\b|\bbase64\b|\bapi[ _-]?keys?\b|\bprivate\s+keys?\b"
WEAK = r"(?i)\b(?:secrets?|credentials?|passwords?)\b"
PLACE = r"(?i)https?://|[\w.+-]+@[\w-]+\.[a-z]{2,}"
INVISIBLE = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]"
ALL_RULES = (*RULES, "exfiltration", "invisible-unicode")


def lines(texts: DataFrame) -> DataFrame:
    """path, line, text: numbered lines; a mark at the start of a file isn't part of it."""
    own = F.regexp_replace(F.regexp_replace("text", r"^\x{FEFF}", ""), r"\r\n?", "\n")
    return texts.select("path", F.posexplode(F.split(own, "\n"))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def injection(texts: DataFrame) -> DataFrame:
    """path, line, rule: one scan; each rule is a condition of the same projection."""
    t = F.col("text")
    exfil = t.rlike(EXFILTRATE) | (t.rlike(OUTBOUND_ANY) & t.rlike(STRONG)) | (t.rlike(OUTBOUND) & t.rlike(WEAK) & t.rlike(PLACE))
    met = [F.when(t.rlike(p), F.lit(n)) for n, p in RULES.items()] + [F.when(exfil, "exfiltration"), F.when(t.rlike(INVISIBLE), "invisible-unicode")]
    return lines(texts).select("path", "line", F.explode(F.array_compact(F.array(*met))).alias("rule"))


def injection_counts(findings: DataFrame) -> DataFrame:
    """rule, n: every rule, with zeros."""
    spark = findings.sparkSession
    rules = spark.createDataFrame([(r,) for r in ALL_RULES], "rule string")
    return rules.join(findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def budget(sizes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """type, n, median, p90, least, most, thin, over from id, type, tokens; ``targets`` has type, min, max.

    Percentiles are exact order statistics: ranked within the type by a window,
    so no type is gathered into one row.
    """
    from pyspark.sql.window import Window

    own = sizes.withColumns({"i": F.row_number().over(Window.partitionBy("type").orderBy("tokens", "id")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("type"))})
    half, at = F.floor(F.col("n") / 2), F.bround(0.9 * (F.col("n") - 1))
    if targets is not None:
        own = own.join(targets, "type", "left")
    else:
        own = own.withColumns({"min": F.lit(None).cast("long"), "max": F.lit(None).cast("long")})
    pick = lambda c: F.max(F.when(c, F.col("tokens")))
    out = own.groupBy("type").agg(
        F.max("n").cast("long").alias("n"), pick(F.col("i") == half).alias("hi"), pick((F.col("i") == half - 1) & (F.col("n") % 2 == 0)).alias("lo"),
        pick(F.col("i") == at).alias("p90"), F.min("tokens").alias("least"), F.max("tokens").alias("most"),
        F.count(F.when(F.col("tokens") < F.col("min"), 1)).alias("thin"), F.count(F.when(F.col("tokens") > F.col("max"), 1)).alias("over"),
    )
    return out.select("type", "n", F.when(F.col("lo").isNull(), F.col("hi")).otherwise(F.floor((F.col("lo") + F.col("hi")) / 2)).cast("long").alias("median"), "p90", "least", "most", "thin", "over")


def navigation(top: DataFrame, citations: DataFrame, files: DataFrame, listing_tokens: int) -> DataFrame:
    """qid, best, incomplete: reading the listing and every source that the first hit cites; repeated citations count again."""
    cited = top.join(citations, "id", "left").select("qid", T.source_path(F.col("source")).alias("path"))
    sized = cited.join(files.select("path", "tokens"), "path", "left")
    return sized.groupBy("qid").agg((F.lit(listing_tokens) + F.sum(F.coalesce("tokens", F.lit(0)))).cast("long").alias("best"), F.max(F.col("path").isNull() | F.col("tokens").isNull()).alias("incomplete"))


def audit(groups: DataFrame, sources: tuple[DataFrame, DataFrame], links: tuple[DataFrame, DataFrame], literals: tuple[DataFrame, DataFrame], enums: tuple[DataFrame, DataFrame]) -> DataFrame:
    """final, kind, draft, value: what a merge lost. Each pair is (of drafts, of finals) with id, value; enums also have field."""
    from .curation import lost

    out = None
    for kind, (drafts, finals) in (("lost-source", sources), ("lost-link", links), ("lost-date", literals)):
        own = lost(groups, drafts, finals).select("final", F.lit(kind).alias("kind"), "draft", "value")
        out = own if out is None else out.unionByName(own)
    drafts, finals = enums
    met = groups.select("final", F.explode("drafts").alias("draft")).join(drafts.select(F.col("id").alias("draft"), "field", "value"), "draft")
    many = met.groupBy("final", "field").agg(F.countDistinct("value").alias("n")).where("n >= 2").select("final", "field")
    kept = finals.select(F.col("id").alias("final"), "field", F.col("value").alias("kept"))
    gone = met.join(many, ["final", "field"]).join(kept, ["final", "field"], "left").where(F.col("kept").isNull() | (F.col("kept") != F.col("value")))
    return out.unionByName(gone.select("final", F.lit("enum-collapse").alias("kind"), "draft", F.concat_ws("=", "field", "value").alias("value")))
