"""Operators over pairs of documents, tables and windows, against brute force and SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kbengine.llm import chat_format, decontamination, jaccard_join, line_dedup, queries, sharding, substring_dedup

from .conftest import prose

SF = "/root/testdata/sf0.01"


def brute_removed(rows, units):
    """For rows with distinct ids: numbers of units that occur before, in order of id (null last) and number."""
    seen, gone = set(), {}
    for i, t in sorted(((i, t) for i, t in rows if t), key=lambda x: (x[0] is None, x[0] or 0)):
        for k, u in units(t):
            if u in seen:
                gone.setdefault(i, []).append(k)
            seen.add(u)
    return gone


def line_units(t):
    return [(k, c.removesuffix("\n")) for k, c in enumerate(line_dedup.chunks(t)) if "\n" in c and line_dedup.counts(c)]


def span_units(t):
    _, words = substring_dedup.sentences(t)
    first, end = substring_dedup.spans(np.array([len(w) for w in words], np.int64))
    return [(a, tuple(w for s in words[a:b] for w in s)) for a, b in zip(first.tolist(), end.tolist(), strict=True)]


@pytest.mark.parametrize(("op", "units"), [(line_dedup, line_units), (substring_dedup, span_units)])
def test_repeats_equal_brute_force(spark, make, clash, corpus, op, units):
    rows = [r for k, r in enumerate(corpus) if r[0] is not None or k == len(corpus) - 2]  # one null id
    docs = clash(make(rows))
    out = op.dedup(docs)
    assert out.columns == [*docs.columns, "n_removed", "removed"]
    gone = brute_removed(rows, units)
    assert len(gone) >= 3
    got = out.collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        marks = gone.get(r.doc_id)
        want = op.cut_out(texts[r.doc_id], marks)[0] if marks else texts[r.doc_id]
        assert r.text == want
        if marks:
            assert r.n_chars == len(want)
    assert op.dedup(docs.where("false")).count() == 0


@pytest.mark.parametrize("op", [line_dedup, substring_dedup])
def test_repeated_rows_are_one_document(spark, make, op):
    rng = random.Random(9)
    text = "\n".join("A line of words with number " + str(rng.random()) + "." for _ in range(20))
    rows = [(1, text), (1, text), (1, "x" + text), (2, text)]
    left = sorted((r.doc_id, r.text == text, len(r.text)) for r in op.dedup(make(rows)).collect())
    assert sum(same for _, same, _ in left) in (0, 2)  # both copies of the row, or the other text came first
    assert any(n < 100 for i, _, n in left if i == 2)


def test_chunks_join_to_the_text_and_resist_shifts():
    rng = random.Random(4)
    lines = [f"line {rng.random()}" for _ in range(200)]
    text = "\n".join(lines)
    assert "".join(line_dedup.chunks(text)) == text and "".join(line_dedup.chunks("a\n\n\nb\n")) == "a\n\n\nb\n"
    other = "\n".join([*lines[:50], "new", *lines[50:]])
    assert len(set(line_dedup.chunks(text)) - set(line_dedup.chunks(other))) <= 3


def test_sentences_cover_the_text(corpus):
    for _, t in corpus:
        starts, words = substring_dedup.sentences(t or "")
        assert [w for s in words for w in s] == (t or "").split()
        if words:
            assert starts[-1] == len(t) and len(starts) == len(words) + 1


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def by_text(x):
    return sorted(x, key=str)


def test_jaccard_equals_brute_force(spark, make, clash, corpus):
    rows = [*corpus, (3, corpus[3][1]), (4, "other text with five words or more")]  # a repeated row, a repeated id
    got = [tuple(r) for r in jaccard_join.join(clash(make(rows))).collect()]
    assert by_text(got) == by_text(brute_components(rows))
    assert jaccard_join.join(make(rows).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_near_the_threshold(spark, make, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        n = rng.choice([5, 6, 8, 9, 12, 20, 33, 64, 65, 130])
        base = [f"w{k}x{j}" for j in range(n)]
        for _ in range(3):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["new" + str(rng.random())], [own[at], "more"]])
            rows.append((len(rows), " ".join(own)))
    got = [tuple(r) for r in jaccard_join.join(make(rows)).collect()]
    assert by_text(got) == by_text(brute_components(rows))


def test_signatures_cover_all_similar_sets():
    rng = np.random.default_rng(1)
    none = np.empty(0, np.uint64)
    for n in [4, 5, 9, 17, 31, 32, 33, 63, 64, 100, 127, 128, 300, 511, 513, 2000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // 5 + 1))
            b = np.sort(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)]))
            if jaccard_join.linked(a, b) and len(a) >= 4 and len(b) >= 4:
                common = np.sort(rng.choice(a, len(a) // 2, replace=False))
                for hot in (none, common):
                    assert np.intersect1d(jaccard_join.signatures(a, hot), jaccard_join.signatures(b, hot)).size or np.array_equal(a, b)


def test_representatives(spark, make, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    kept = {r.doc_id for r in jaccard_join.representatives(make(rows + rows[:2])).collect()}
    assert kept == {i for i, _, c in brute_components(rows) if i == c or c is None}


def connection():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_chat_equals_sql(spark):
    got = sorted(map(str, map(tuple, queries.op4_chat_windows(spark, SF).collect())))
    cols = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows"
    assert got == sorted(map(str, connection().sql(f"SELECT {cols} FROM ({chat_format.SQL})").fetchall()))


def test_chat_windows(spark, clash):
    rows = [(1, 0, "system", "be good # <"), *((1, k + 1, ("user", "assistant")[k % 2], f"turn {k} " + "w " * (20 * k)) for k in range(9))]
    rows += [(2, None, None, None), (2, 1, "assistant", r"\l</turn> ### a: \\"), (2, 1, "assistant", r"\l</turn> ### a: \\"), (None, 1, "us:er", "x"), (3, 0, "assistant", "long " * 600)]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_format.formatted(df, 200)
    back = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    assert [tuple(t) for t in back[1].turns] == [(r, t) for c, _, r, t in rows if c == 1]
    assert back[1].targets == [t for c, _, r, t in rows if c == 1 and r == "assistant"]
    assert [tuple(t) for t in back[2].turns] == [("", ""), ("assistant", rows[11][3]), ("assistant", rows[11][3])]
    assert back[2].targets == [rows[11][3]] * 2 and [tuple(t) for t in back[None].turns] == [("us:er", "x")]
    assert back[3].n_windows == 1
    windows = next(r for r in out.collect() if r.conv_id == 1).windows
    assert len(windows) > 2 and all(w.text.startswith("### system: be good \\h \\l</turn>\n") for w in windows)
    for w in windows:
        turns = w.text.split("</turn>\n")[:-1]
        assert sum(len(t.split(": ", 1)[1].split()) + 3 for t in turns) <= 200 or len(turns) - w.repeated == 1
        assert all(w.text[s.end : s.end + 7] == "</turn>" for s in w.loss)
    assert chat_format.digest(df.where("false")).count() == 0


def test_shards(spark, make, clash, corpus):
    own = queries.table(spark, SF, "documents")
    got = sorted(map(str, map(tuple, sharding.shards(own, 1 << 16).collect())))
    assert got == sorted(map(str, connection().sql(sharding.SQL.format(limit=1 << 16)).fetchall()))
    rows = corpus + [(77, "same " * 100)] * 50 + [(78, "z" * 5000)]
    out = sharding.shards(clash(make(rows)), 2000).collect()
    assert len(out) == len(rows)
    total = {}
    for r in out:
        total.setdefault((r.shard, r.part), []).append(r.n_bytes)
        assert r.oversized == (r.shard_bytes > 2000)
    assert all(sum(v) <= 2000 or len(v) == 1 for v in total.values())
    assert sharding.shards(make([]).where("false"), 10).count() == 0


def test_shards_written(spark, make, tmp_path):
    rows = [(1, c * 900) for c in "abc"] + [(2, "same " * 100)] * 7 + [(None, None), (3, "z" * 5000), (4, "")]
    docs = make(rows).withColumns({"shard": F.lit("x"), "key": F.lit("y"), "number": F.lit(1)})
    sharding.write(docs, 1000, f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {"key", "number", "n_chars"} <= set(out.columns)
    got = out.select("doc_id", "text", F.input_file_name().alias("f")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
    sizes = {}
    for r in got:
        sizes.setdefault(r.f.rpartition("/")[0], []).append(len(r.text or ""))
    assert all(sum(v) <= 1000 or len(v) == 1 for v in sizes.values())


def test_columns_named_as_the_result(spark, make):
    docs = make([(1, "A line of words.\nAnother line of words."), (2, "A line of words.\nAnother line of words.")]).withColumns({"removed": F.lit("x"), "n_removed": F.lit("y"), "__h": F.lit("h")})
    for op in (line_dedup, substring_dedup):
        out = op.dedup_runs(docs)
        assert out.columns == [*(c for c in docs.columns if c not in ("removed", "n_removed")), "n_removed", "removed"]
        assert {r.doc_id: (r.n_removed, r["__h"]) for r in out.collect()} == {1: (0, "h"), 2: (2, "h")}


def test_benchmark_templates(spark, make, clash):
    items = [
        (1, "A train leaves Rome at 3 km per hour and the slow bus from Milan needs 3 hours to cover 40 km of road near Rome."),
        (2, "short one here"), (3, None), (4, ""), (1, "A train leaves Rome at 3 km per hour and the slow bus from Milan needs 3 hours to cover 40 km of road near Rome."),
    ]
    same = "A train leaves Paris at 7 km per hour and the slow bus from Lyon needs 7 hours to cover 90 km of road near Paris."
    mixed = "A train leaves Paris at 7 km per hour and the slow bus from Lyon needs 2 hours to cover 5 km of road near Turin."
    rows = [(1, "Intro words. " + items[0][1] + " And more."), (2, "x. " + same), (3, "x. " + mixed), (4, items[0][1].upper()), (5, "A train leaves the town and goes on to the sea."), (6, None), (7, ""), (8, "well, short one here then"), (2, "x. " + same)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(clash(make(rows)), bench).collect()
    assert sorted((r.doc_id, r.item_ids) for r in got) == [(1, "1"), (2, "1"), (2, "1"), (3, ""), (4, "1"), (5, ""), (6, ""), (7, ""), (8, "2")]
    kept = decontamination.clean(clash(make(rows)), bench)
    assert kept.columns == clash(make(rows)).columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7]
    assert decontamination.report(make(rows), bench.where("false")).where("contaminated").count() == 0


def test_benchmark_passages_in_the_tables(spark):
    docs, bench = ({r[0]: r.text for r in queries.table(spark, SF, n).collect()} for n in ("documents", "benchmark"))
    fold = lambda t: " ".join(w.strip(".,!?;:").lower() for w in t.split())
    want = {d for d, t in docs.items() if any(fold(b) in fold(t) for b in bench.values())}
    got = {r.doc_id for r in queries.op10_template_decontamination(spark, SF).where("contaminated").collect()}
    assert want and want <= got and len(got) <= len(want) + 2


def test_benchmarks_beyond_the_broadcast(spark, make, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 3)
    rng = random.Random(0)
    items = [(k, " ".join(str(rng.random())[2:7] + "abc" for _ in range(12))) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(make([(0, items[0][1] + " " + items[7][1]), (1, items[5][1])]), bench)
    assert sorted((r.doc_id, r.item_ids) for r in got.collect()) == [(0, "0,7"), (1, "5")]


def plain_match(item, text):
    """By brute force: whether some alignment of the item's words with the text's has 60 % of its eight-word template windows and slots of one value each."""

    def template(words):
        out = []
        for k, w in enumerate(words):
            core = w.strip(decontamination.EDGE)
            if re.fullmatch(r"[0-9.]+", core):
                out.append("#")
            elif core[:1].isupper() and not core.isupper() and k and words[k - 1][-1] not in ".!?:":
                out.append("@")
            elif core.lower() in decontamination.UNITS and out and out[-1] == "#":
                out.append("%")
            else:
                out.append(core.lower())
        return out

    a, b = item.split(), text.split()
    x, y = template(a), template(b)
    plain = lambda t: sum(c not in "#@%" for c in t) >= 4
    own = [q for q in range(len(x) - 7) if plain(x[q : q + 8])]
    for d in range(-len(x), len(y)):
        met = [q for q in own if 0 <= q + d <= len(y) - 8 and x[q : q + 8] == y[q + d : q + d + 8]]
        if met and len({tuple(x[q : q + 8]) for q in met}) >= 0.6 * len({tuple(x[q : q + 8]) for q in own}):
            slots, by = {q + j for q in met for j in range(8) if x[q + j] in ("#", "@", "%")}, {}
            for q in slots:
                by.setdefault((x[q], a[q].strip(decontamination.EDGE)), []).append(b[q + d].strip(decontamination.EDGE))
            if sum(max(map(v.count, v)) for v in by.values()) >= 0.8 * len(slots):
                return True
    return False


def test_templates_equal_a_plain_matcher(spark, make):
    rng = random.Random(12)
    word = lambda: "w" + "".join(rng.choices("abcdefgh", k=5))
    forms, items = [], []
    for k in range(6):
        form = [rng.choice(["#0", "#1", "@0", "@1"]) if rng.random() < 0.25 else word() for _ in range(rng.randint(14, 40))]
        form[0] = word()
        forms.append(form)
        items.append((k, " ".join({"#": str(11 + 7 * k + int(w[1:] or 0)), "@": f"Name{k}{w[1:]}"}.get(w[0], w) if w[0] in "#@" else w for w in form)))
    rows = []
    for k in range(160):
        form = list(rng.choice(forms))
        values = {s: (str(rng.randint(100, 999)) if s[0] == "#" else "Else" + "".join(rng.choices("abc", k=4))) for s in ("#0", "#1", "@0", "@1")}
        mixed = rng.random() < 0.4
        own = [(values[w] if not mixed else str(rng.randint(100, 999)) if w[0] == "#" else "Else" + "".join(rng.choices("abc", k=4))) if w in values else w for w in form]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            own[rng.randrange(len(own))] = word()
        lead = [word() for _ in range(rng.randint(1, 9))]
        rows.append((k, " ".join([*lead, *own[: rng.choice([len(own), len(own), len(own) * 2 // 3])], word()])))
    got = {r.doc_id: set(filter(None, r.item_ids.split(","))) for r in decontamination.report(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: {str(k) for k, item in items if plain_match(item, t)} for i, t in rows}
    assert got == want and sum(map(bool, want.values())) > 30 and sum(not v for v in want.values()) > 20


def test_items_behind_many_partial_copies(spark, make):
    rng = random.Random(6)
    word = lambda: "w" + "".join(rng.choices("abcdefgh", k=6))
    own = [word() for _ in range(42)]
    for at in (3, 20, 36):
        own[at] = "17"
    other = ["19" if k == 3 else "23" if k == 20 else w for k, w in enumerate(own[:32])]
    rows = [(n, " ".join([*(other * n), *own])) for n in (1, 63, 64, 300)] + [(1000, " ".join(other * 64))]
    got = {r.doc_id: r.item_ids for r in decontamination.report(make(rows), spark.createDataFrame([(5, " ".join(own))], "item_id long, text string")).collect()}
    assert [got[n] for n in (1, 63, 64, 300)] == ["5"] * 4


def test_runs_go_by_chunks_and_the_rest_by_pairs(make, monkeypatch):
    rng = random.Random(6)
    shared = [f"line {k} of a shared passage" for k in range(40)]
    docs = []
    for k in range(30):
        at, n = rng.randrange(36), rng.choice([2, 3, 12, 30])
        own = [f"own {k} {i}" for i in range(rng.randint(0, 6))]
        docs.append((k, "\n".join([*own, *shared[at : at + n], "", *own[:1], *shared[at : at + 3]]) + rng.choice(["", "\n"])))
    asked, units = [], line_dedup.repeats.units
    monkeypatch.setattr(line_dedup.repeats, "units", lambda d, cut: asked.append(cut) or units(d, cut))
    got = {r.doc_id: r.text for r in line_dedup.dedup_runs(make(docs)).collect()}
    assert asked == [line_dedup.cut, line_dedup.cut_rest]
    seen, want = set(), {}
    for k, text in docs:
        at = line_dedup.worded(text)
        own = [text[a[0] : b[1]] for a, b in zip(at, at[1:])]
        later = []
        for i, x in enumerate(own):
            later += [i] if x in seen else []
            seen.add(x)
        want[k] = line_dedup.cut_out_pairs(text, later)[0] if later else text
    assert got == want
    text = docs[2][1]
    n = len(line_dedup.chunks(text))
    assert n > 1 and len(line_dedup.cut_rest(text, list(range(n)))[0]) == sum(1 for i in range(n)) - 1


def test_documents_without_repeated_lines_are_not_exchanged(make, monkeypatch):
    rng = random.Random(9)
    shared = "\n".join(prose(rng, 8) for _ in range(12))
    rows = [(k, "\n".join(prose(rng, 8) for _ in range(6))) for k in range(200)]
    rows += [(200, shared), (201, prose(rng, 8) + "\n" + shared), (None, shared), (202, None), (203, "")]
    asked, with_marks = [], line_dedup.repeats.with_marks
    monkeypatch.setattr(line_dedup.repeats, "with_marks", lambda d, *a: asked.append({r.doc_id for r in d.select("doc_id").collect()}) or with_marks(d, *a))
    got = line_dedup.dedup_runs(make(rows)).collect()
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in got if r.doc_id is None or r.doc_id > 199) == sorted([
        ("200", shared, 0), ("201", rows[201][1].split("\n")[0] + "\n", 12), ("None", "", 12), ("202", None, 0), ("203", "", 0),
    ], key=lambda x: x[0]) and {r.doc_id: r.text for r in got if r.doc_id is not None and r.doc_id < 200} == dict(rows[:200])
    # for chunks' bytes, pairs' hashes, pairs' bytes and the texts; a few others may share a bit
    assert len(asked) == 4 and all(len(x) < 10 for x in asked) and {201, None} <= asked[0] & asked[3]
