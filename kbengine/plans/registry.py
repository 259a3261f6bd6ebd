"""The registered queries over the derived relations, each with the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, corpus, curation, federation, release, reports, retrieval
from ..sources import bundle
from .fixtures import TOK, Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# --- text


@query(f"SELECT doc_id, len({TOK.format('text')})::BIGINT AS n_tokens, len(list_distinct({TOK.format('text')}))::BIGINT AS n_distinct, CASE WHEN text = '' THEN 0 ELSE greatest(1, round_even(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 0.75, 0)) END::BIGINT AS token_count FROM documents")
def tokenize_stats(t: Tables) -> DataFrame:
    toks = T.tokenize(F.col("text"))
    return t.read("documents").select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_distinct"), T.token_count(F.col("text")).alias("token_count"))


@query(sql("SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM toks) GROUP BY ALL", "toks"))
def weighted_field_tf(t: Tables) -> DataFrame:
    return t.index.postings.select("id", "term", F.col("f").alias("tf"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::BIGINT AS n_links, len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: x LIKE 'http%'))::BIGINT AS n_outside FROM pages")
def page_links(t: Tables) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t.read("pages").select("page_id", F.size(hrefs).cast("long").alias("n_links"), F.size(F.filter(hrefs, lambda x: x.startswith("http"))).cast("long").alias("n_outside"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '\\d{4}-\\d{2}-\\d{2}|\\b(?:19|20)\\d{2}\\b|\\d+(?:\\.\\d+)?%'), ',') AS literals FROM documents")
def literals(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.array_join(T.literals(F.col("text")), ",").alias("literals"))


@query(sql("SELECT id, source, split_part(source, '#', 1) AS path, CASE WHEN source LIKE '%#L%' THEN regexp_extract(source, '#L(\\d+)', 1)::INT END AS first, CASE WHEN source LIKE '%#L%' THEN regexp_extract(source, '-L(\\d+)$', 1)::INT END AS last FROM cites", "cites"))
def source_anchors(t: Tables) -> DataFrame:
    first, last = T.line_anchor(F.col("source"))
    return t.citations.select("id", "source", T.source_path(F.col("source")).alias("path"), first.alias("first"), last.alias("last"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 3 THEN chr(10) ELSE '' END AS span, CASE WHEN length(text) > 200 THEN left(text, 200) || chr(10) || '[truncated]' ELSE text END AS capped FROM documents")
def spans_and_caps(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", T.line_span(F.col("text"), F.lit(1), F.lit(3)).alias("span"), T.cap(F.col("text"), 200).alias("capped"))


@query("SELECT doc_id, CASE WHEN k = '' THEN 'proposal' ELSE k END AS kebab FROM (SELECT doc_id, lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '-')) AS k FROM documents)")
def kebab_names(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", T.kebab(F.col("text")).alias("kebab"))


# --- corpora


@query(sql("SELECT '.md' AS ext, count(*) AS files, sum(bytes)::BIGINT AS bytes, sum(greatest(1, bytes // 4))::BIGINT AS tokens_est FROM files", "files"))
def corpus_survey_by_ext(t: Tables) -> DataFrame:
    return corpus.by_ext(corpus.survey(corpus.files(t.files.select("path", "text"))))


@query(sql("SELECT path, bytes, greatest(1, bytes // 4)::BIGINT AS tokens_est, greatest(1, bytes // 4) > 50000 AS oversized FROM files", "files"))
def corpus_survey(t: Tables) -> DataFrame:
    return corpus.survey(t.files).select("path", "bytes", "tokens_est", "oversized")


@query(sql("SELECT i::BIGINT AS i, path FROM (SELECT path, row_number() OVER (ORDER BY split(path, '/')) - 1 AS i, count(*) OVER () AS n FROM files) WHERE i % greatest(1, n // 25) = 0 ORDER BY i LIMIT 25", "files"))
def survey_samples(t: Tables) -> DataFrame:
    return corpus.samples(t.files).select(F.col("i").cast("long").alias("i"), "path")


@query(sql("SELECT path, sha256 FROM files", "files"))
def manifest(t: Tables) -> DataFrame:
    return t.files.select("path", "sha256")


@query(sql("SELECT path, change FROM drift", "drift"))
def manifest_diff(t: Tables) -> DataFrame:
    return corpus.diff(t.old_manifest, t.new_manifest)


@query(sql("SELECT id, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM (SELECT id, split_part(source, '#', 1) AS path FROM cites) JOIN drift USING (path) WHERE change IN ('changed', 'removed') GROUP BY id", "cites", "drift"))
def affected_concepts(t: Tables) -> DataFrame:
    return corpus.affected(t.citations, corpus.diff(t.old_manifest, t.new_manifest)).select("id", F.array_join("paths", ",").alias("paths"))


@query(sql("SELECT path FROM drift WHERE change = 'added' AND path NOT IN (SELECT path FROM cited)", "drift", "cited"))
def uncovered_new(t: Tables) -> DataFrame:
    return corpus.uncovered_new(corpus.diff(t.old_manifest, t.new_manifest), t.citations)


@query(sql("SELECT id, count(*) AS n_sources FROM (SELECT id, split_part(source, '#', 1) AS path FROM cites) c LEFT JOIN (SELECT path, 1 AS gone FROM drift WHERE change = 'removed') USING (path) GROUP BY id HAVING count(*) = count(gone)", "cites", "drift"))
def stale_candidates(t: Tables) -> DataFrame:
    return corpus.stale_candidates(t.citations, corpus.diff(t.old_manifest, t.new_manifest))


@query(sql("SELECT path, s::INT AS start, least(s + 3999, length(text))::INT AS \"end\", greatest(1, (least(s + 3999, length(text)) - s + 1) // 4)::BIGINT AS tokens_est FROM files, LATERAL (SELECT unnest(range(1, length(text) + 1, 4000)) AS s)", "files"))
def char_windows(t: Tables) -> DataFrame:
    return corpus.char_windows(t.files, 1000)


_CHUNKS = """
s AS (SELECT path, text, bytes // 4 AS est, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM files),
big AS (SELECT path, text, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM s WHERE est > 1000),
l AS (SELECT path, i, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank, sum(length(line) // 4) OVER w AS p, sum(length(line) + 1) OVER w AS c, length(text) AS chars FROM big WINDOW w AS (PARTITION BY path ORDER BY i)),
t AS (SELECT path, count(*) AS lines, max(p) AS total, greatest(2, ceil(max(p) / 1000))::BIGINT AS n, coalesce(max(i) FILTER (blank), -1) AS last, any_value(chars) AS chars FROM l GROUP BY path),
r(path, k, lo) AS (
  SELECT path, 0::BIGINT, 0::BIGINT FROM t
  UNION ALL
  SELECT r.path, r.k + 1, arg_min(l.i, (abs(l.p - t.total * (r.k + 1) / t.n), l.i)) FROM r JOIN t USING (path) JOIN l ON l.path = r.path AND l.i > r.lo AND CASE WHEN t.last > r.lo THEN l.blank ELSE l.i <= t.lines - 2 END
  WHERE r.k + 1 < t.n GROUP BY r.path, r.k),
e AS (SELECT path, CASE WHEN k = 0 THEN 0 ELSE lo + 1 END AS a FROM r),
b AS (SELECT path, a, coalesce(lead(a) OVER (PARTITION BY path ORDER BY a), lines) AS z, lines, chars AS whole FROM e JOIN t USING (path)),
m AS (SELECT b.path, a, z, coalesce(q.p, 0) AS p0, x.p AS p1, coalesce(q.c, 0) AS c0, CASE WHEN z = lines THEN whole ELSE x.c END AS c1 FROM b LEFT JOIN l q ON q.path = b.path AND q.i = a - 1 JOIN l x ON x.path = b.path AND x.i = z - 1 WHERE z > a),
o AS (
  SELECT path, 'lines' AS kind, a + 1 AS "start", z AS "end", greatest(1, p1 - p0) AS tokens_est, a, 0 AS w FROM m WHERE p1 - p0 <= 1000
  UNION ALL
  SELECT path, 'chars', w + 1, least(w + 4000, c1), greatest(1, (least(w + 4000, c1) - w) // 4), a, w FROM (SELECT *, unnest(range(c0::BIGINT, c1::BIGINT, 4000)) AS w FROM m WHERE p1 - p0 > 1000))
SELECT path, 0 AS pos, 'file' AS kind, NULL::BIGINT AS "start", NULL::BIGINT AS "end", greatest(1, est)::BIGINT AS tokens_est FROM s WHERE est <= 1000
UNION ALL SELECT path, (row_number() OVER (PARTITION BY path ORDER BY a, w) - 1)::INT, kind, "start"::BIGINT, "end"::BIGINT, tokens_est::BIGINT FROM o
"""


@query(sql(_CHUNKS, "files", recursive=True))
def line_chunks(t: Tables) -> DataFrame:
    return corpus.chunk_files(t.files, 1000)


PACKED = """
o AS (SELECT path, greatest(1, bytes // 4) AS t, row_number() OVER (ORDER BY split(path, '/')) AS i FROM files),
p(i, used, seg) AS (
  SELECT 0::BIGINT, 0::BIGINT, 1
  UNION ALL
  SELECT o.i, CASE WHEN p.used > 0 AND p.used + o.t > 5000 THEN o.t ELSE p.used + o.t END, p.seg + CASE WHEN p.used > 0 AND p.used + o.t > 5000 THEN 1 ELSE 0 END
  FROM p JOIN o ON o.i = p.i + 1)
SELECT 'all' AS corpus, printf('segment-%02d', seg) AS id, count(*) AS entries, sum(o.t)::BIGINT AS tokens_est FROM p JOIN o USING (i) GROUP BY seg
"""


@query(sql(PACKED, "files", recursive=True))
def greedy_segments(t: Tables) -> DataFrame:
    entries = t.files.select(F.lit("all").alias("corpus"), "path", F.lit(0).alias("pos"), T.size_estimate(F.col("bytes")).alias("tokens_est"))
    return corpus.segments(corpus.pack(entries, 5000))


@query(sql("SELECT path, segment FROM segs WHERE status = 'done' AND path NOT IN (SELECT path FROM cited)", "segs", "cited"))
def glean_entries(t: Tables) -> DataFrame:
    return corpus.glean(t.segments, t.citations).select("path", "segment")


# --- retrieval

_BM25 = """
hits AS (SELECT {m}ref AS id, ord, len(tokens) AS dl, term, count(*) AS f FROM (SELECT {m}ref, ord, tokens, unnest(tokens) AS term FROM pool) WHERE term IN (SELECT term FROM times) GROUP BY ALL),
df AS (SELECT {m}term, count(*) AS n FROM hits GROUP BY ALL),
st AS (SELECT {m}count(*) AS docs, avg(len(tokens)) AS mean FROM pool {g}),
total AS (SELECT qid, {m}id, ord, sum(times * ln(1 + (docs - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean))) AS score
  FROM hits JOIN df USING ({m}term) JOIN times USING (term) {j} GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY qid{p} ORDER BY round(score, 9) DESC, ord) AS rank FROM total)
"""


def _bm25(where: str, n: int, member: bool = False) -> str:
    parts = _BM25.format(m="member, " if member else "", g="GROUP BY member" if member else "", j="JOIN st USING (member)" if member else "CROSS JOIN st", p=", member" if member else "")
    return f"pool AS (SELECT * REPLACE ({'ref' if member else 'id'} AS ref) FROM toks WHERE {where}), {parts.strip()}"


def _ranked(top: DataFrame) -> DataFrame:
    return top.select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(sql(_bm25("true", 10) + " SELECT qid, rank::INT AS rank, id, round(score, 6) AS score FROM top WHERE rank <= 10", "toks", "times", recursive=True))
def bm25_batch_topk(t: Tables) -> DataFrame:
    return _ranked(retrieval.bm25(retrieval.pool(t.index), t.asked, 10))


@query(sql(_bm25("type = 'en' AND NOT stale", 10) + " SELECT qid, rank::INT AS rank, id, round(score, 6) AS score FROM top WHERE rank <= 10", "toks", "times", recursive=True))
def bm25_filtered_topk(t: Tables) -> DataFrame:
    return _ranked(retrieval.bm25(retrieval.pool(t.index, type_="en", include_stale=False), t.asked, 10))


ASK = "the of and threlyes"
_ONE = "times AS (SELECT 0 AS qid, term, count(*) AS times FROM (SELECT unnest(['the', 'of', 'and', 'threlyes']) AS term) GROUP BY ALL), "


@query(sql(_ONE + _bm25("true", 10) + " SELECT rank::INT AS rank, id, NULL::VARCHAR AS via, round(score, 6) AS score FROM top WHERE rank <= 10", "toks", recursive=True))
def bm25_topk(t: Tables) -> DataFrame:
    top, _ = retrieval.query(t.index, [], ASK, 10)
    return top.select("rank", "id", "via", F.round("score", 6).alias("score"))


LEXICON = [
    {"term": "threlyes", "status": "accepted", "maps_to": ["en/doc_000000000001", "gone/doc"], "canonical_terms": ["ouble"]},
    {"term": "ouble", "status": "accepted", "maps_to": ["en/doc_000000000002"], "canonical_terms": []},
    {"term": "and", "status": "ambiguous", "maps_to": ["en/doc_000000000006"]},
]
_PINNED = "times AS (SELECT 0 AS qid, term, count(*) AS times FROM (SELECT unnest(['the', 'of', 'and', 'threlyes', 'ouble']) AS term) GROUP BY ALL), "


@query(
    sql(
        _PINNED + _bm25("id <> 'en/doc_000000000001'", 10)
        + ", pins AS (SELECT count(*) AS k FROM toks WHERE id = 'en/doc_000000000001')"
        + " SELECT 1 AS rank, id, 'lexicon' AS via, NULL::DOUBLE AS score FROM toks WHERE id = 'en/doc_000000000001' UNION ALL SELECT (rank + k)::INT, id, NULL, round(score, 6) FROM top, pins WHERE rank + k <= 10",
        "toks", recursive=True,
    )
)
def lexicon_pinned_topk(t: Tables) -> DataFrame:
    top, _ = retrieval.query(t.index, LEXICON, ASK, 10)
    return top.select("rank", "id", "via", F.round("score", 6).alias("score"))


@query(sql("SELECT c.id, coalesce((SELECT string_agg(dst, ',' ORDER BY pos) FROM (SELECT dst, min(pos) AS pos FROM links WHERE src = c.id GROUP BY dst)), '') AS out, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM links WHERE dst = c.id), '') AS backlinks FROM concepts c", "links", "concepts"))
def links_backlinks(t: Tables) -> DataFrame:
    return retrieval.link_lists(t.links, t.concepts).select("id", F.array_join("out", ",").alias("out"), F.array_join("backlinks", ",").alias("backlinks"))


@query(sql("SELECT * FROM (SELECT id, type, title, description, (count(*) OVER ())::BIGINT AS total FROM concepts WHERE type = 'fr' ORDER BY split(id || '.md', '/') LIMIT 20)", "concepts"))
def overview(t: Tables) -> DataFrame:
    own, total = retrieval.overview(t.index, "fr", 20)
    return own.crossJoin(F.broadcast(total))


_EVAL = "SELECT doc_id, CASE quality WHEN 1 THEN 'pass' ELSE 'fail' END AS owner, CASE toxic WHEN 0 THEN 'pass' ELSE 'fail' END AS llm FROM docs"


@query(sql(f"SELECT lang, count(*) AS \"of\", count(*) FILTER (e = 'pass') AS passed, count(*) FILTER (e = 'fail') AS failed, count(*) FILTER (e = 'pending') AS pending, count(quality) AS owner_confirmed, count(quality) < count(*) AS provisional FROM (SELECT lang, quality, coalesce(CASE WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'fail' END, CASE WHEN toxic = 0 THEN 'pass' WHEN toxic = 1 THEN 'fail' END, 'pending') AS e FROM docs) GROUP BY lang", "docs"))
def eval_status(t: Tables) -> DataFrame:
    verdict = lambda c, good: F.when(F.col(c) == good, "pass").when(F.col(c) == 1 - good, "fail")
    rows = t.docs.select("lang", verdict("quality", 1).alias("owner_verdict"), verdict("toxic", 0).alias("llm_verdict"))
    return retrieval.verdict_status(rows.groupBy("lang"))


@query(sql(_bm25("true", 5) + " SELECT a.qid, coalesce(bool_or(t.id = 'en/doc_' || lpad((a.qid * 7)::VARCHAR, 12, '0')), false) AS outcome FROM asked a LEFT JOIN top t ON t.qid = a.qid AND t.rank <= 5 GROUP BY a.qid", "toks", "times", "asked", recursive=True))
def adversarial_outcome(t: Tables) -> DataFrame:
    top = retrieval.bm25(t.index, t.asked, 5).groupBy("qid").agg(F.collect_list("id").alias("ids"))
    concept = F.concat(F.lit("en/doc_"), F.lpad((F.col("qid") * 7).cast("string"), 12, "0"))
    none = F.array().cast("array<string>")
    return t.asked.select("qid").join(top, "qid", "left").select("qid", retrieval.adversarial(F.lit("covered"), concept, F.coalesce("ids", none), none).alias("outcome"))


# --- federation


@query(sql("SELECT member, ref, norm FROM (SELECT member, ref, array_to_string(" + TOK.format("title") + ", ' ') AS norm FROM members) WHERE norm <> ''", "members"))
def name_norms(t: Tables) -> DataFrame:
    return federation.norms(t.members)


_RRF = _bm25("true", 10, True) + ", rrf AS (SELECT qid, member, id AS ref, rank - 1 AS rank, 1.0::DOUBLE / (60 + rank) AS rrf FROM top WHERE rank <= 10)"


@query(sql(_RRF + " SELECT qid, member, ref, rank::INT AS rank, round(rrf, 9) AS rrf FROM rrf", "toks", "times", recursive=True))
def rrf_federated_topk(t: Tables) -> DataFrame:
    return federation.member_ranks(t.index, t.asked, 10).select("qid", "member", "ref", "rank", F.round("rrf", 9).alias("rrf"))


_MERGED = _RRF + """, root AS (SELECT dst AS ref, src AS root FROM same UNION ALL SELECT DISTINCT src, src FROM same),
mr AS (SELECT qid, CASE member WHEN 'm3' THEN 'constraints' ELSE 'knowledge' END AS role, coalesce(root, rrf.ref) AS root, rrf.ref, rrf.rrf FROM rrf LEFT JOIN root ON root.ref = rrf.ref),
merged AS (SELECT qid, role, root, arg_min(ref, (round(-rrf, 12), ref)) AS ref, sum(rrf) AS score, list(DISTINCT ref) AS refs FROM mr GROUP BY qid, role, root),
placed AS (SELECT qid, role, root, ref, score, array_to_string(list_sort(list_filter(refs, lambda x: x <> ref)), ',') AS duplicates, row_number() OVER (PARTITION BY qid, role ORDER BY round(score, 12) DESC, ref) AS place FROM merged)"""


def _placed(t: Tables, n: int) -> tuple[DataFrame, DataFrame]:
    roots = federation.same_as(t.crosswalk)
    roles = t.members.select("member", "role").distinct()
    return federation.split(federation.merge(federation.member_ranks(t.index, t.asked, 10), roots, roles), n), roots


@query(sql(_MERGED + " SELECT qid, role, place::INT AS place, ref, round(score, 9) AS score, duplicates FROM placed WHERE place <= 10", "toks", "times", "same", recursive=True))
def same_as_merge(t: Tables) -> DataFrame:
    top, _ = _placed(t, 10)
    return top.select("qid", "role", "place", "ref", F.round("score", 9).alias("score"), F.array_join("duplicates", ",").alias("duplicates"))


@query(sql(_MERGED + """, hit AS (SELECT DISTINCT qid, root FROM placed WHERE role = 'knowledge' AND place <= 5),
d AS (SELECT qid, root.ref AS dst FROM hit JOIN root USING (root) UNION SELECT qid, root FROM hit)
SELECT DISTINCT qid, b.src AS ref FROM d JOIN bound b USING (dst) WHERE b.status = 'accepted'""", "toks", "times", "same", "bound", recursive=True))  # fmt: skip
def constrains_pull(t: Tables) -> DataFrame:
    top, roots = _placed(t, 10)
    return federation.pulled(top, roots, t.crosswalk)


@query(sql("SELECT dst AS node, src AS root FROM same UNION SELECT src, src FROM same", "same"))
def same_as_components(t: Tables) -> DataFrame:
    return federation.same_as(t.crosswalk)


@query(sql("n AS (SELECT member, ref, array_to_string(" + TOK.format("title") + ", ' ') AS norm FROM members) SELECT DISTINCT a.ref AS src, b.ref AS dst FROM n a JOIN n b ON a.norm = b.norm AND a.member < b.member WHERE a.norm <> ''", "members", recursive=True))
def crosswalk_exact(t: Tables) -> DataFrame:
    return federation.candidates_exact(t.members)


@query(sql("SELECT src, rel, dst, status FROM (SELECT src, 'same-as' AS rel, dst, 'accepted' AS status FROM same UNION ALL SELECT src, 'constrains', dst, status FROM bound) WHERE status = 'accepted' AND src NOT IN (SELECT ref FROM members WHERE stale) AND dst NOT IN (SELECT ref FROM members WHERE stale)", "same", "bound", "members"))
def active_crosswalk(t: Tables) -> DataFrame:
    nobody = t.spark.createDataFrame([], "member string")
    return federation.active(t.crosswalk, t.members.where("stale").select("ref"), nobody).select("src", "rel", "dst", "status")


# --- curation


@query(sql("SELECT src, pos::INT AS pos, dst FROM links WHERE dst NOT IN (SELECT id FROM concepts)", "links", "concepts"))
def dangling_links(t: Tables) -> DataFrame:
    return curation.dangling(t.links, t.concepts).select("src", "pos", "dst")


@query(sql("SELECT id FROM (SELECT id FROM concepts UNION ALL SELECT upper(id) FROM concepts WHERE stale) WHERE id NOT IN (SELECT dst FROM links)", "links", "concepts"))
def orphans(t: Tables) -> DataFrame:
    c = t.concepts
    return curation.orphans(t.links, c.select("id").unionByName(c.where("stale").select(F.upper("id").alias("id"))))


_BROKEN = "SELECT id AS src, 0 AS pos, 'moved/' || split_part(id, '/', 2) AS dst FROM concepts"


@query(sql("SELECT src, pos::INT AS pos, dst, CASE WHEN n = 1 THEN sole END AS suggestion, CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS outcome FROM (" + _BROKEN + ") b JOIN (SELECT split_part(id, '/', 2) AS name, count(*) AS n, min(id) AS sole FROM concepts GROUP BY 1) c ON c.name = split_part(b.dst, '/', 2)", "concepts"))
def repair_by_basename(t: Tables) -> DataFrame:
    broken = t.concepts.select(F.col("id").alias("src"), F.lit(0).alias("pos"), F.concat(F.lit("moved/"), curation.basename(F.col("id"))).alias("dst"))
    return curation.repair(broken, t.concepts)


@query(sql("SELECT root, array_to_string(list_sort(list(id)), ',') AS ids FROM (SELECT id, min(id) OVER (PARTITION BY type, k) AS root FROM (SELECT id, type, list_sort(list_distinct(" + TOK.format("first") + ")) AS k FROM (SELECT id, type, title AS first FROM concepts))) GROUP BY root", "concepts"))
def same_title_drafts(t: Tables) -> DataFrame:
    return curation.cluster(t.concepts, 1.0).select("root", F.array_join("ids", ",").alias("ids"))


@query(sql("k AS (SELECT id, type, list_distinct(" + TOK.format("title") + ") AS s FROM concepts), e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.type = b.type AND a.id < b.id AND list_has_any(a.s, b.s) WHERE len(list_intersect(a.s, b.s)) >= 0.6 * len(list_distinct(list_concat(a.s, b.s))) UNION SELECT a.id, b.id FROM k a JOIN k b ON a.type = b.type AND a.id < b.id AND len(a.s) = 0 AND len(b.s) = 0), b2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT id, id FROM k UNION SELECT b2.b, r.root FROM r JOIN b2 ON b2.a = r.node) SELECT root, array_to_string(list_sort(list(node)), ',') AS ids FROM (SELECT node, min(root) AS root FROM r GROUP BY node) GROUP BY root", "concepts", recursive=True))
def draft_clusters(t: Tables) -> DataFrame:
    return curation.cluster(t.concepts).select("root", F.array_join("ids", ",").alias("ids"))


_RISK = "risk AS (SELECT c.id, c.type, CASE WHEN h.id IS NOT NULL THEN 1 ELSE 0 END AS hit, c.stale::INT AS st, CASE WHEN coalesce(p.n, 0) <= 1 THEN 1 ELSE 0 END AS weak, CASE WHEN r.n <= 2 THEN 1 ELSE 0 END AS rare FROM concepts c LEFT JOIN (SELECT id, count(DISTINCT split_part(source, '#', 1)) AS n FROM cites GROUP BY id) p USING (id) JOIN (SELECT type, count(*) AS n FROM concepts GROUP BY type) r USING (type) LEFT JOIN (SELECT DISTINCT id FROM cites JOIN drift ON drift.path = split_part(source, '#', 1) WHERE change IN ('changed', 'removed')) h ON h.id = c.id)"


@query(sql(_RISK + " SELECT id, type, concat_ws(',', CASE WHEN hit = 1 THEN 'changed-source' END, CASE WHEN st = 1 THEN 'stale' END, CASE WHEN weak = 1 THEN 'weak-coverage' END, CASE WHEN rare = 1 THEN 'rare-type' END) AS tags FROM risk", "concepts", "cites", "drift", recursive=True))
def review_risk_tags(t: Tables) -> DataFrame:
    return _risk(t).select("id", "type", F.array_join("tags", ",").alias("tags"))


def _risk(t: Tables) -> DataFrame:
    return curation.risk_tags(t.concepts, t.citations, corpus.diff(t.old_manifest, t.new_manifest))


@query(sql(_RISK + ", s AS (SELECT id, type, hit + st + weak + rare AS k, sha256('seed:' || id) AS r, sha256('seed:' || type) AS rt FROM risk), a AS (SELECT id FROM s WHERE k > 0 ORDER BY k DESC, r LIMIT 40) SELECT id, 'risk' AS tier FROM a UNION ALL SELECT id, 'type-coverage' FROM (SELECT id, row_number() OVER (PARTITION BY type ORDER BY r) AS k FROM s WHERE type NOT IN (SELECT type FROM s WHERE id IN (SELECT id FROM a))) WHERE k = 1 AND (SELECT count(*) FROM a) = 40", "concepts", "cites", "drift", recursive=True))
def review_sample_risk(t: Tables) -> DataFrame:
    return curation.review_sample(_risk(t), "seed", 40).select("id", "tier")


@query(sql("s AS (SELECT id, type, sha256('seed:' || id) AS r, sha256('seed:' || type) AS rt FROM concepts), f AS (SELECT id, row_number() OVER (PARTITION BY type ORDER BY r) AS round, rt, r FROM s) SELECT id, 'fill' AS tier FROM (SELECT id, row_number() OVER (ORDER BY round, rt, r) AS k FROM f) WHERE k <= 30", "concepts", recursive=True))
def review_sample_fill(t: Tables) -> DataFrame:
    return curation.review_sample(t.concepts.select("id", "type", F.array().cast("array<string>").alias("tags")), "seed", 30).select("id", "tier")


_GROUPS = "g0 AS (SELECT h, min(ref) AS final, list_sort(list(ref)) AS drafts FROM mh GROUP BY h HAVING count(*) >= 2), g AS (SELECT final, unnest(drafts) AS draft FROM g0)"


def _groups(t: Tables) -> DataFrame:
    """Equal texts are drafts of the least ref; every draft is mapped by two rows, of which the last counts."""
    m = t.members.select("ref", F.sha2(F.col("body").cast("binary"), 256).alias("h"))
    least = m.groupBy("h").agg(F.min("ref").alias("final"))
    rows = m.join(least, "h").select("ref", "final")
    ledger = rows.select(F.lit(1).alias("ord"), F.create_map("ref", F.lit("earlier")).alias("merge_map")).unionByName(rows.select(F.lit(2).alias("ord"), F.create_map("ref", "final").alias("merge_map")))
    return curation.merge_groups(ledger)


@query(sql(_GROUPS + " SELECT final, array_to_string(drafts, ',') AS drafts FROM g0", "mh", recursive=True))
def merge_groups(t: Tables) -> DataFrame:
    return _groups(t).select("final", F.array_join("drafts", ",").alias("drafts"))


@query(sql(_GROUPS + ", s AS (SELECT m.ref AS id, split_part(c.source, '#', 1) AS value FROM members m JOIN cites c USING (id)) SELECT g.final, g.draft, s.value FROM g JOIN s ON s.id = g.draft WHERE NOT EXISTS (SELECT 1 FROM s f WHERE f.id = g.final AND f.value = s.value)", "mh", "members", "cites", recursive=True))
def merge_lost_sources(t: Tables) -> DataFrame:
    own = t.members.select("id", "ref").join(t.citations, "id").select(F.col("ref").alias("id"), T.source_path(F.col("source")).alias("value"))
    return curation.lost(_groups(t), own, own)


@query(sql(_GROUPS + ", s AS (SELECT DISTINCT ref AS id, unnest(regexp_extract_all(source || ' of 2021-03-0' || (regexp_extract(source, '(\\d+)$', 1)::INT % 9 + 1)::VARCHAR || ' ' || type, '\\d{4}-\\d{2}-\\d{2}')) AS value FROM members) SELECT g.final, g.draft, s.value FROM g JOIN s ON s.id = g.draft WHERE NOT EXISTS (SELECT 1 FROM s f WHERE f.id = g.final AND f.value = s.value)", "mh", "members", recursive=True))
def merge_lost_literals(t: Tables) -> DataFrame:
    m = t.members
    told = F.concat(F.col("tags")[0], F.lit(" of 2021-03-0"), (F.regexp_extract(F.col("tags")[0], r"(\d+)$", 1).cast("int") % 9 + 1).cast("string"), F.lit(" "), F.col("type"))
    own = m.select(F.col("ref").alias("id"), F.explode(F.array_distinct(T.literals(told))).alias("value"))
    return curation.lost(_groups(t), own, own)


@query(sql("SELECT segment, arg_max(class, (ts, event_id)) AS class FROM led GROUP BY segment", "led"))
def latest_span_outcomes(t: Tables) -> DataFrame:
    return curation.latest_spans(t.ledger.withColumn("spans", F.col("class"))).select("segment", F.col("spans").alias("class"))


@query(sql("d AS (SELECT lang AS \"group\", doc_id AS ord, CASE WHEN toxic = 1 THEN 'split' ELSE 'no-schism' END AS verdict, CASE WHEN lang = 'de' AND quality = 0 THEN 'yes' END AS waiver, 'f' || source AS fp FROM docs WHERE lang <> 'fr' OR toxic IS NOT NULL), a AS (SELECT \"group\", arg_max(fp, ord) FILTER (waiver IS NOT NULL) AS w, bool_or(waiver IS NOT NULL) AS aw, bool_or(verdict = 'split') AS sp, arg_max(fp, ord) AS last FROM d GROUP BY 1), c AS (SELECT DISTINCT lang AS \"group\", 'fsrc1' AS cur FROM docs) SELECT c.\"group\", CASE WHEN aw IS NULL THEN 'unadjudicated' WHEN aw THEN CASE WHEN w = cur THEN 'closed' ELSE 'stale' END WHEN sp THEN 'open' WHEN last = cur THEN 'closed' ELSE 'stale' END AS state FROM c LEFT JOIN a USING (\"group\")", "docs", recursive=True))
def dissent_state(t: Tables) -> DataFrame:
    d = t.docs.where("lang != 'fr' OR toxic IS NOT NULL")
    rows = d.select(F.col("lang").alias("group"), F.col("doc_id").alias("ord"), F.when(F.col("toxic") == 1, "split").otherwise("no-schism").alias("verdict"), F.when((F.col("lang") == "de") & (F.col("quality") == 0), "yes").alias("waiver"), F.concat(F.lit("f"), "source").alias("adjudication_fingerprint"))
    return curation.dissent_state(rows, t.docs.select(F.col("lang").alias("group"), F.lit("fsrc1").alias("current")).distinct())


@query(sql("SELECT source, sha256(string_agg(id || ':' || sha256(body), chr(10) ORDER BY split(id || '.md', '/'))) AS fingerprint FROM concepts GROUP BY source", "concepts"))
def package_fingerprint(t: Tables) -> DataFrame:
    rows = t.concepts.select("id", F.col("tags")[0].alias("source"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))
    return curation.fingerprint(rows, ["source"])


# --- reports

_TOKENS = "SELECT id, type, greatest(1, round_even(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) / 0.75, 0))::BIGINT AS tokens FROM concepts"


@query(sql(f"SELECT type, len(v)::BIGINT AS n, (CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE (v[len(v) // 2] + v[len(v) // 2 + 1]) // 2 END)::BIGINT AS median, v[round_even(0.9 * (len(v) - 1), 0)::INT + 1] AS p90, v[1] AS least, v[-1] AS most, len(list_filter(v, lambda x: x < 100))::BIGINT AS thin, len(list_filter(v, lambda x: x > 1000))::BIGINT AS over FROM (SELECT type, list_sort(list(tokens)) AS v FROM ({_TOKENS}) GROUP BY type)", "concepts"))
def budget_by_type(t: Tables) -> DataFrame:
    sizes = t.concepts.select("id", "type", T.token_count(F.col("body")).alias("tokens"))
    targets = t.concepts.select("type").distinct().select("type", F.lit(100).alias("min"), F.lit(1000).alias("max"))
    return reports.budget(sizes, targets)


_LINES = "l AS (SELECT path, unnest(range(1, len(s) + 1)) AS line, unnest(s) AS t FROM (SELECT path, string_split(text, chr(10)) AS s FROM risky))"
_HITS = """f AS (
  SELECT path, line, 'instruction-override' AS rule FROM l WHERE regexp_matches(t, '(?i)\\b(?:ignore|disregard|forget|override)\\s+(?:(?:all|any|the|your)\\s+)?(?:previous|prior|earlier|above|preceding)\\s+(?:instruction|prompt|rule|message|direction|constraint)s?\\b|\\bdisregard\\s+(?:the\\s+)?(?:system|developer)\\s+(?:prompt|message|instruction)s?\\b')
  UNION ALL SELECT path, line, 'role-injection' FROM l WHERE regexp_matches(t, '(?i)^\\s*(?:[-*>]\\s*)?(?:system|developer|assistant)\\s*:')
  UNION ALL SELECT path, line, 'template-tag' FROM l WHERE regexp_matches(t, '(?i)<\\s*/?\\s*system\\b[^>]*>|<\\|\\s*im_(?:start|end)\\s*\\|>|\\[\\s*/?\\s*INST\\s*\\]')
  UNION ALL SELECT path, line, 'identity-reassignment' FROM l WHERE regexp_matches(t, '(?i)\\byou\\s+are\\s+now\\s+(?:a|an|the)?\\s*(?:[a-z][\\w-]*\\s+){0,2}(?:assistant|ai|model|agent|bot|chatbot|admin|administrator|root|developer|system|persona|dan|jailbroken|unrestricted|uncensored)\\b|\\bfrom\\s+now\\s+on,?\\s+you\\s+(?:are|will|must|should)\\b|\\byour\\s+new\\s+(?:role|instructions?|persona|identity)\\b')
  UNION ALL SELECT path, line, 'exfiltration' FROM l WHERE regexp_matches(t, '(?i)\\bexfiltrat(?:e|es|ed|ing|ion)\\b')
    OR (regexp_matches(t, '(?i)\\b(?:curl|wget|send|upload|transmit|email|beacon|post)\\b') AND regexp_matches(t, '(?i)\\.env\\b|\\bbase64\\b|\\bapi[ _-]?keys?\\b|\\bprivate\\s+keys?\\b'))
    OR (regexp_matches(t, '(?i)\\b(?:curl|wget|send|upload|transmit|email|beacon)\\b') AND regexp_matches(t, '(?i)\\b(?:secrets?|credentials?|passwords?)\\b') AND regexp_matches(t, '(?i)https?://|[\\w.+-]+@[\\w-]+\\.[a-z]{2,}'))
  UNION ALL SELECT path, line, 'invisible-unicode' FROM l WHERE regexp_matches(t, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{E0000}-\\x{E007F}]'))"""


@query(sql(f"{_LINES}, {_HITS} SELECT path, line::INT AS line, rule FROM f", "risky", recursive=True))
def injection_findings(t: Tables) -> DataFrame:
    return reports.injection(t.risky)


@query(sql(f"{_LINES}, {_HITS} SELECT r.rule, count(f.path) AS n FROM (SELECT unnest(['instruction-override', 'role-injection', 'template-tag', 'identity-reassignment', 'exfiltration', 'invisible-unicode']) AS rule) r LEFT JOIN f USING (rule) GROUP BY r.rule", "risky", recursive=True))
def injection_counts(t: Tables) -> DataFrame:
    return reports.injection_counts(reports.injection(t.risky))


@query(sql(_bm25("true", 1) + ", z AS (SELECT path, greatest(1, bytes // 4) AS tokens FROM files) SELECT t.qid, (1000 + sum(coalesce(z.tokens, 0)))::BIGINT AS best, bool_or(z.tokens IS NULL) AS incomplete FROM top t LEFT JOIN cites c ON c.id = t.id LEFT JOIN z ON z.path = split_part(c.source, '#', 1) WHERE rank <= 1 GROUP BY t.qid", "toks", "times", "cites", "files", recursive=True))
def naive_cost(t: Tables) -> DataFrame:
    top = retrieval.bm25(t.index, t.asked, 1).select("qid", "id")
    return reports.navigation(top, t.citations, t.files.select("path", T.size_estimate(F.col("bytes")).alias("tokens")), 1000)



# --- checks and release


def _finding(df: DataFrame) -> DataFrame:
    return df.select("level", "code", "path", "message")


@query(sql("SELECT 'error' AS level, 'E_ID_COLLISION' AS code, id AS path, other AS message FROM (SELECT id, lag(id) OVER (PARTITION BY lower(id) ORDER BY split(id || '.md', '/')) AS other FROM (SELECT id FROM concepts UNION ALL SELECT upper(id) FROM concepts WHERE stale)) WHERE other IS NOT NULL", "concepts"))
def id_collisions(t: Tables) -> DataFrame:
    c = t.concepts
    return _finding(checks.id_collisions(c.select("id").unionByName(c.where("stale").select(F.upper("id").alias("id")))))


RULES = {
    "required_fields": {"_all": ["title", "owner"], "fr": ["reviewed"]},
    "field_enums": {"en": {"status": ["active", "superseded"]}},
}


@query(sql("m AS (SELECT id, type, title, CASE WHEN quality = 1 THEN 'team' END AS owner, CASE WHEN toxic IS NOT NULL THEN 'yes' END AS reviewed, CASE quality WHEN 1 THEN 'active' WHEN 0 THEN 'unknown' END AS status FROM concepts JOIN docs USING (doc_id)) SELECT 'error' AS level, 'E_REQUIRED_FIELD' AS code, id AS path, 'title' AS message FROM m WHERE coalesce(title, '') = '' UNION ALL SELECT 'error', 'E_REQUIRED_FIELD', id, 'owner' FROM m WHERE owner IS NULL UNION ALL SELECT 'error', 'E_REQUIRED_FIELD', id, 'reviewed' FROM m WHERE type = 'fr' AND reviewed IS NULL UNION ALL SELECT 'error', 'E_FIELD_ENUM', id, 'status' FROM m WHERE type = 'en' AND status NOT IN ('active', 'superseded')", "concepts", "docs", recursive=True))
def archetype_findings(t: Tables) -> DataFrame:
    c = t.concepts.join(t.docs.select("doc_id", "quality", "toxic"), "doc_id")
    meta = F.map_filter(F.create_map(F.lit("title"), F.col("title"), F.lit("owner"), F.when(F.col("quality") == 1, "team"), F.lit("reviewed"), F.when(F.col("toxic").isNotNull(), "yes"), F.lit("status"), F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "unknown")), lambda k, v: v.isNotNull())
    return _finding(checks.archetype(c.withColumn("meta", meta), RULES))


@query(sql("SELECT 'warning' AS level, 'W_BAD_SOURCE' AS code, id AS path, source AS message FROM cites WHERE split_part(source, '#', 1) NOT IN (SELECT path FROM newm)", "cites", "newm"))
def source_check(t: Tables) -> DataFrame:
    return _finding(checks.source_existence(t.citations, t.new_manifest))


@query(sql("d AS (SELECT path, max(bytes) AS bytes FROM segs WHERE status = 'done' GROUP BY path) SELECT count(*) AS files, count(c.path) AS cited, sum(bytes)::BIGINT AS bytes, coalesce(sum(bytes) FILTER (c.path IS NOT NULL), 0)::BIGINT AS cited_bytes, round_even(100 * count(c.path) / count(*), 0)::BIGINT AS files_pct, round_even(100 * coalesce(sum(bytes) FILTER (c.path IS NOT NULL), 0) / sum(bytes), 0)::BIGINT AS bytes_pct FROM d LEFT JOIN cited c USING (path)", "segs", "cited", recursive=True))
def reverse_coverage(t: Tables) -> DataFrame:
    return checks.coverage(t.segments, t.citations)


@query(sql("SELECT 'warning' AS level, 'W_SOURCE_OUTSIDE_SCOPE' AS code, path, 'cited but not planned' AS message FROM cited WHERE path IN (SELECT path FROM files) AND path NOT IN (SELECT path FROM segs WHERE status = 'done')", "cited", "files", "segs"))
def outside_scope(t: Tables) -> DataFrame:
    return _finding(checks.outside_scope(t.citations, t.segments.where("status = 'done'"), t.files))


_ASSIGNED = "asg AS (SELECT segment, path AS span FROM segs), rep AS (SELECT segment, span, class FROM (SELECT s.segment, s.path AS span, CASE WHEN f.quality = 0 THEN 'dropped' WHEN f.toxic = 1 THEN 'reviewed_empty' ELSE 'covered' END AS class FROM segs s JOIN files f USING (path) WHERE f.lang <> 'es' UNION ALL SELECT s.segment, s.path, 'covered' FROM segs s JOIN files f USING (path) WHERE f.toxic = 1 UNION ALL SELECT segment, 'invented/' || path, 'covered' FROM segs JOIN files USING (path) WHERE quality = 0))"


def _reported(t: Tables) -> DataFrame:
    s = t.segments.join(t.files.select("path", "quality", "toxic", "lang"), "path")
    kind = F.when(F.col("quality") == 0, "dropped").when(F.col("toxic") == 1, "reviewed_empty").otherwise("covered")
    own = s.where("lang != 'es'").select("segment", F.col("path").alias("span"), kind.alias("class"))
    again = s.where("toxic = 1").select("segment", F.col("path").alias("span"), F.lit("covered").alias("class"))
    made = s.where("quality = 0").select("segment", F.concat(F.lit("invented/"), "path").alias("span"), F.lit("covered").alias("class"))
    return own.unionByName(again).unionByName(made)


@query(sql(_ASSIGNED + ", r AS (SELECT segment, span, count(DISTINCT class) AS n FROM rep GROUP BY ALL) SELECT 'error' AS level, CASE WHEN a.span IS NULL THEN 'E_SPAN_UNKNOWN' WHEN n IS NULL THEN 'E_SPAN_UNACCOUNTED' ELSE 'E_SPAN_DOUBLE' END AS code, coalesce(a.segment, r.segment) AS path, coalesce(a.span, r.span) AS message FROM asg a FULL JOIN r ON r.segment = a.segment AND r.span = a.span WHERE a.span IS NULL OR n IS NULL OR n > 1", "segs", "files", recursive=True))
def span_partition(t: Tables) -> DataFrame:
    return _finding(checks.span_partition(t.segments.select("segment", F.col("path").alias("span")), _reported(t)))


@query(sql(_ASSIGNED + " SELECT DISTINCT 'warning' AS level, 'W_SPAN_COVERAGE_CONTRADICTION' AS code, segment AS path, span AS message FROM rep WHERE class = 'covered' AND span IN (SELECT path FROM segs WHERE status = 'done' AND path NOT IN (SELECT path FROM cited))", "segs", "files", "cited", recursive=True))
def span_contradiction(t: Tables) -> DataFrame:
    return _finding(checks.span_contradiction(_reported(t), checks.uncited(t.segments, t.citations)))


@query(sql("SELECT 'warning' AS level, 'W_BAD_ANCHOR' AS code, id AS path, c.source AS message FROM cites c JOIN files f ON f.path = split_part(c.source, '#', 1) WHERE c.source LIKE '%#L1-L4' AND len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END < 4", "cites", "files"))
def anchor_check(t: Tables) -> DataFrame:
    return _finding(checks.anchors(t.citations, t.files))


@query(sql("SELECT 'warning' AS level, 'W_DANGLING_LINK' AS code, src AS path, dst AS message FROM links WHERE dst NOT IN (SELECT id FROM concepts)", "links", "concepts"))
def dangling_findings(t: Tables) -> DataFrame:
    return _finding(checks.dangling(t.links, t.concepts))


@query(sql("SELECT 'error' AS level, 'E_STALE_FIELDS' AS code, id AS path, 'stale without a date' AS message FROM concepts WHERE stale", "concepts"))
def stale_fields(t: Tables) -> DataFrame:
    c = t.concepts.select("id", "stale", F.lit("toxic").alias("stale_reason"), F.create_map(F.lit("stale_since"), F.lit("soon")).alias("meta"))
    return _finding(checks.stale_fields(c))


@query(sql("SELECT 'E_REL_SPAN_DROPPED' AS code, segment || ' ' || path AS message FROM segs JOIN files USING (path) WHERE quality = 0 AND lang <> 'es' UNION ALL SELECT 'E_REL_SPAN_COVERAGE_MISSING', segment FROM (SELECT DISTINCT segment FROM segs WHERE status = 'done') WHERE segment NOT IN (SELECT segment FROM segs JOIN files USING (path) WHERE lang <> 'es' OR toxic = 1 OR quality = 0)", "segs", "files"))
def release_spans(t: Tables) -> DataFrame:
    return release.spans_reported(t.segments, _reported(t))


@query(sql(f"{_LINES}, {_HITS}, n AS (SELECT 'E_REL_INJECTION' AS code, count(*) AS n FROM f UNION ALL SELECT 'E_REL_SEGMENTS', count(DISTINCT segment) FROM segs WHERE status <> 'done' UNION ALL SELECT 'E_REL_DISSENT_OPEN', count(DISTINCT lang) FROM docs WHERE toxic = 1) SELECT false AS ok, string_agg(code || '=' || n::VARCHAR, ',' ORDER BY code || '=' || n::VARCHAR) AS problems FROM n WHERE n > 0", "risky", "segs", "docs", recursive=True))
def release_verdict(t: Tables) -> DataFrame:
    segs = t.segments.select("segment", "status").distinct()
    jobs = segs.select("segment", F.sha2("segment", 256).alias("digest"))
    ledger = jobs.select("segment", F.col("digest").alias("job_digest"))
    states = t.docs.groupBy(F.col("lang").alias("group")).agg(F.when(F.max("toxic") == 1, "open").otherwise("closed").alias("state"))
    return release.verdict(release.injection_free(reports.injection(t.risky)), release.provenance_complete(segs, jobs, ledger), release.dissent(states))


@query(sql("SELECT member || '/' || id || '.md' AS path, body || coalesce(s, '') || coalesce(b, '') AS body FROM members LEFT JOIN (SELECT ref, chr(10) || '## See also' || chr(10) || chr(10) || string_agg(item, chr(10) ORDER BY item) || chr(10) AS s FROM (SELECT DISTINCT ref, '- [/' || replace(o, ':', '/') || '](/' || replace(o, ':', '/') || '.md)' AS item FROM (SELECT src AS ref, dst AS o FROM same UNION ALL SELECT dst, src FROM same)) GROUP BY ref) USING (ref) LEFT JOIN (SELECT ref, chr(10) || '## Constraints (cross-bundle)' || chr(10) || chr(10) || string_agg(item, chr(10) ORDER BY item) || chr(10) AS b FROM (SELECT DISTINCT dst AS ref, '- [/' || replace(src, ':', '/') || '](/' || replace(src, ':', '/') || '.md)' AS item FROM bound WHERE status = 'accepted') GROUP BY ref) USING (ref)", "members", "same", "bound"))
def export_fusion(t: Tables) -> DataFrame:
    return bundle.export_fusion(t.members, t.crosswalk)


@query(sql("SELECT type, '## ' || type || chr(10) || chr(10) || string_agg('- [' || title || '](' || id || '.md)' || CASE WHEN description <> '' THEN ' — ' || description ELSE '' END, chr(10) ORDER BY id) || chr(10) AS section FROM concepts GROUP BY type", "concepts"))
def index_markdown(t: Tables) -> DataFrame:
    return bundle.index_markdown(t.concepts.withColumn("kind", F.lit("final")))


@query()
def crosswalk_fuzzy(t: Tables) -> DataFrame:
    return federation.candidates_fuzzy(t.members)
