"""Projection-level functions, as Spark columns wherever Spark can express them."""

from __future__ import annotations

import difflib
import hashlib
import json
import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

TOKEN = r"[\p{L}\p{N}]+"
#: Fixed weights of a concept's fields in its token list.
WEIGHTS = {"title": 3, "aliases": 3, "tags": 2, "description": 2, "body": 1}
LINK = r"\[[^\]]*\]\(([^)\s]+)\)"
# A fixed pattern: ISO dates, years and percentages.
LITERAL = r"\d{4}-\d{2}-\d{2}|\b(?:19|20)\d{2}\b|\d+(?:\.\d+)?%"


def tokenize(text: Column) -> Column:
    """Runs of letters and digits, lower-cased after matching."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def joined(values: Column) -> Column:
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), " ")


def weighted_tokens(title: Column, aliases: Column, tags: Column, description: Column, body: Column) -> Column:
    """All fields' tokens, each field repeated by its weight."""
    fields = {"title": title, "aliases": joined(aliases), "tags": joined(tags), "description": description, "body": body}
    return F.concat(*(F.flatten(F.array_repeat(tokenize(c), WEIGHTS[n])) if WEIGHTS[n] > 1 else tokenize(c) for n, c in fields.items()))


def token_count(text: Column) -> Column:
    """Words over 0.75, half to even; at least 1 for any text, 0 for none."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when((text.isNull()) | (text == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(words / 0.75).cast("int"))).cast("long")


def size_estimate(n_bytes: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_bytes / 4)).cast("long")


def links(body: Column) -> Column:
    """Targets of Markdown links and images, in order."""
    return F.regexp_extract_all(body, F.lit(LINK), F.lit(1))


def resolve(path: str, target: str) -> str | None:
    """The concept id that a link in the document at ``path`` (without suffix) leads to."""
    target = target.partition("#")[0]
    if not target or target.startswith(("http://", "https://", "mailto:")) or not target.endswith(".md"):
        return None
    where = target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(path), target)
    where = posixpath.normpath(where)
    return None if where.startswith("..") else where[:-3]


@F.pandas_udf(StringType())
def resolve_link(path: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or t is None else resolve(p, t) for p, t in zip(path, target, strict=True)], dtype=object)


def source_path(source: Column) -> Column:
    return F.substring_index(source, "#", 1)


def line_anchor(source: Column) -> tuple[Column, Column]:
    """First and last line of ``path#Lx-Ly``; nulls without such an anchor."""
    pattern = r"^[^#]*#L(\d+)(?:-L(\d+))?$"
    first, last = F.regexp_extract(source, pattern, 1), F.regexp_extract(source, pattern, 2)
    start = F.when(first != "", first.cast("int"))
    return start, F.when(last != "", last.cast("int")).otherwise(start)


def heading_slugs(text: Column) -> Column:
    """Anchors of the ATX headings, with a dash for each space, and with runs collapsed."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(1)), F.lower)
    bare = F.transform(raw, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, r":[a-z0-9_+-]+:", ""), r"(?U)[^\w\s-]", "")))
    return F.array_union(F.transform(bare, lambda h: F.regexp_replace(h, r"\s", "-")), F.transform(bare, lambda h: F.regexp_replace(h, r"[\s-]+", "-")))


def section(body: Column, name: str) -> Column:
    """The text under ``## name`` up to the next such heading; null if there is none."""
    pattern = rf"(?ims)^##[ \t]+{re.escape(name)}[ \t]*$\n?(.*?)(?=^##[ \t]|\z)"
    return F.when(body.rlike(rf"(?im)^##[ \t]+{re.escape(name)}[ \t]*$"), F.regexp_extract(body, pattern, 1))


def cap(text: Column, most: int, marker: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(marker))).otherwise(text)


def span_key(path: Column, kind: Column, start: Column, end: Column) -> Column:
    """``path``, ``path#L1-40`` or ``path#C1-4000``."""
    whole = kind.isNull() | (kind == "file")
    return F.when(whole, path).otherwise(F.concat(path, F.lit("#"), F.when(kind == "lines", "L").otherwise("C"), start.cast("string"), F.lit("-"), end.cast("string")))


def line_span(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, with their line feeds."""
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "")


def literals(value: Column) -> Column:
    """Dates, years and percentages."""
    return F.regexp_extract_all(value, F.lit(f"({LITERAL})"), F.lit(1))


def kebab(text: Column) -> Column:
    out = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(F.coalesce(out, F.lit("")) == "", "proposal").otherwise(out)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ratio(a: Column, b: Column) -> Column:
    """One decimal, half to even; null where it can't be told."""
    return F.when(a.isNull() | b.isNull() | (b == 0), F.lit(None)).otherwise(F.bround(a / b, 1))


def percentile(values: Column, q: float) -> Column:
    """The sorted array's value at round-half-even of q(n - 1)."""
    s = F.array_sort(values)
    return F.get(s, F.bround(F.lit(q) * (F.size(s) - 1)).cast("int"))


def median(values: Column) -> Column:
    """The middle value; of an even number, the floor of the middle two's mean."""
    s, n = F.array_sort(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(0)).when(n % 2 == 1, F.get(s, half)).otherwise(F.floor((F.get(s, half - 1) + F.get(s, half)) / 2)).cast("long")


def parse_ref(ref: Column) -> tuple[Column, Column]:
    """Member and concept id of ``member:id``."""
    return F.substring_index(ref, ":", 1), F.regexp_extract(ref, r"(?s)^[^:]*:(.*)$", 1)


def path_key(concept: Column) -> Column:
    """Sorts as file paths do, component by component."""
    return F.split(F.concat(concept, F.lit(".md")), "/")


def similarity(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])


#: Fixed code points: invisible ones and controls that an excerpt spells out.
INVISIBLE = "​-‍⁠﻿‪-‮⁦-⁩\U000e0000-\U000e007f"
_UNSAFE = re.compile(f"[{INVISIBLE}\x00-\x1f\x7f]")


def excerpt(line: str, most: int = 140) -> str:
    out = _UNSAFE.sub(lambda m: f"<U+{ord(m[0]):04X}>", line.replace("\t", " ")).strip()
    return out[:most] + "..." if len(out) > most else out


@F.pandas_udf(StringType())
def safe_excerpt(line: pd.Series) -> pd.Series:
    return line.map(lambda x: excerpt(x or ""))


def canonical(value: object, compact: bool = False) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":") if compact else None)


def digest(value: object, compact: bool = False) -> str:
    return hashlib.sha256(canonical(value, compact).encode()).hexdigest()
