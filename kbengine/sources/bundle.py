"""Reading bundles and corpora into the canonical tables, and writing them back."""

from __future__ import annotations

import json

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C

CONCEPT = "id string, type string, title string, description string, tags array<string>, aliases array<string>, sources array<string>, stale boolean, stale_reason string, meta map<string,string>, body string, parse_error string"


class FrontmatterError(ValueError):
    pass


class _Loader(yaml.SafeLoader):
    """Refuses mappings that name a key twice."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        for i, k in enumerate(keys):
            if k in keys[:i]:
                raise FrontmatterError(f"duplicate frontmatter key {k!r}")
        return super().construct_mapping(node, deep)


def parse(text: str) -> tuple[dict, str]:
    """Frontmatter and body."""
    if not text.startswith("---\n"):
        raise FrontmatterError("no opening line of frontmatter")
    inner, closed, body = text[4:].partition("\n---\n")
    if not closed:
        inner, body = text[4:].rstrip("\n"), ""
        if not inner.endswith("\n---"):
            raise FrontmatterError("no closing line of frontmatter")
        inner = inner[:-4]
    try:
        meta = yaml.load(inner, Loader=_Loader)  # a safe loader
    except yaml.YAMLError as e:
        raise FrontmatterError(f"invalid YAML: {e}") from e
    if not isinstance(meta, dict):
        raise FrontmatterError("frontmatter is no mapping")
    return meta, body


def serialise(meta: dict, body: str) -> str:
    return "---\n" + yaml.safe_dump(meta, allow_unicode=True, sort_keys=False).strip() + "\n---\n" + body


def _texts(value) -> list[str]:
    return [] if value in (None, "", []) else [str(x) for x in value] if isinstance(value, list) else [str(value)]


def _row(cid: str, text: str) -> tuple:
    try:
        meta, body = parse(text)
    except FrontmatterError as e:
        return (cid, None, None, None, [], [], [], None, None, {}, text, str(e))
    one = lambda k: None if meta.get(k) is None else str(meta[k])
    coded = {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True, default=str) for k, v in meta.items()}
    return (cid, one("type"), one("title") or "", one("description") or "", _texts(meta.get("tags")), _texts(meta.get("aliases")), _texts(meta.get("sources")), bool(meta.get("stale")), one("stale_reason"), coded, body, None)


def parsed(files: DataFrame) -> DataFrame:
    """Concept rows from id, text. YAML has no native reader, so batches go through Arrow."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([_row(i, t) for i, t in zip(b["id"], b["text"], strict=True)], columns=[c.split(" ")[0] for c in CONCEPT.split(", ")])

    return files.select("id", "text").mapInPandas(run, CONCEPT)


def relative(path: Column, root: str) -> Column:
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    return F.substring_index(path, base, -1)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content: every file below, without hidden ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = raw.select(F.url_decode(F.replace(relative("path", root), F.lit("+"), F.lit("%2B"))).alias("path"), "content")
    return own.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")))


def text_of(content: Column) -> Column:
    """UTF-8 text with its line ends as line feeds."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), r"\r\n?", "\n")


def kind(path: Column) -> Column:
    top = F.split(path, "/")[0]
    return F.when(top == "drafts", "draft").when(top == "proposals", "proposal").when(top == "meta", "meta").otherwise("final")


def read_bundle(spark: SparkSession, root: str, drafts: bool = False, proposals: bool = False) -> DataFrame:
    """The concepts of a bundle, with path, kind and sha256, in no order; ``ord`` sorts them."""
    f = read_files(spark, root).where(F.col("path").endswith(".md"))
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    f = f.where(~name.isin("index.md", "log.md") & ~((F.size(parts) == 1) & name.isin("README.md", "AGENTS.md", "CLAUDE.md")))
    f = f.where((F.lit(drafts) | (parts[0] != "drafts")) & (F.lit(proposals) | (parts[0] != "proposals")))
    f = f.select(F.regexp_replace("path", r"\.md$", "").alias("id"), "path", text_of(F.col("content")).alias("text"), F.sha2("content", 256).alias("sha256"))
    return parsed(f).join(f.select("id", "path", "sha256", kind(F.col("path")).alias("kind"), T.path_key(F.col("id")).alias("ord")), "id")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, text (null where not text), sha256, ext, excluded, is_text."""
    f = read_files(spark, root)
    text = F.when(C.is_text(F.col("content")), text_of(F.col("content")))
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(
        "path", F.octet_length("content").cast("long").alias("bytes"), text.alias("text"), F.sha2("content", 256).alias("sha256"),
        F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)).alias("ext"), C.excluded(F.col("path")).alias("excluded"), text.isNotNull().alias("is_text"),
    )


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only JSON-lines log with ``ord``, their place in the file.

    A log is one file that one process appends to; its lines carry no number, so
    the file is read whole, as one row, and its lines are numbered from that.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\n"))).where(F.trim("col") != "")
    return rows.select(F.col("pos").alias("ord"), F.from_json("col", schema).alias("r")).select("ord", "r.*")


def append_log(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Append rows to a log through the file system that Spark knows for the path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = spark.read.text(path, wholetext=True).first()[0] if fs.exists(where) else ""
    new = old + ("\n" if old and not old.endswith("\n") else "") + "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    out = fs.create(where, True)
    out.write(bytearray(new.encode()))
    out.close()


def write_bundle(concepts: DataFrame, path: str) -> None:
    """Concepts as Parquet, by kind: the form in which later reads prune columns and partitions."""
    concepts.write.mode("overwrite").partitionBy("kind").parquet(path)


def index_markdown(concepts: DataFrame) -> DataFrame:
    """type, section: the generated index, a row a type; join the rows in order of type for the whole."""
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "id", F.lit(".md)"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(""))
    own = concepts.where("kind = 'final'").select("type", F.struct("id", line.alias("line")).alias("x"))
    return own.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("lines")).select("type", F.concat(F.lit("## "), "type", F.lit("\n\n"), "lines", F.lit("\n")).alias("section"))


def export_fusion(members: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """path, body: all members in one tree, absolute links prefixed, accepted same-as pairs and constraints as sections."""
    own = members.select("member", "id", "ref", F.regexp_replace("body", r"\]\(/", F.concat(F.lit("](/"), F.col("member"), F.lit("/"))).alias("body"))
    rows = crosswalk.where("status = 'accepted'")
    same = rows.where("rel = 'same-as'")
    also = same.select(F.col("src").alias("ref"), F.col("dst").alias("other"), F.lit("See also").alias("head")).unionByName(same.select(F.col("dst").alias("ref"), F.col("src").alias("other"), F.lit("See also").alias("head")))
    bound = rows.where("rel = 'constrains'").select(F.col("dst").alias("ref"), F.col("src").alias("other"), F.lit("Constraints (cross-bundle)").alias("head"))
    item = F.concat(F.lit("- [/"), F.replace("other", F.lit(":"), F.lit("/")), F.lit("](/"), F.replace("other", F.lit(":"), F.lit("/")), F.lit(".md)"))
    lists = also.unionByName(bound).distinct().groupBy("ref", "head").agg(F.concat(F.lit("\n## "), "head", F.lit("\n\n"), F.array_join(F.array_sort(F.collect_list(item)), "\n"), F.lit("\n")).alias("part"))
    parts = lists.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("head") != "See also", "part"))), lambda x: x["part"]), "").alias("parts"))
    return own.join(parts, "ref", "left").select(F.concat("member", F.lit("/"), "id", F.lit(".md")).alias("path"), F.concat("body", F.coalesce("parts", F.lit(""))).alias("body"))
