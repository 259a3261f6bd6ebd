"""What the registered queries once left out, each held against the whole job."""

import random
import re

import pytest

from kbengine.llm import pii_crf, queries

from .conftest import documents, prose


def stored(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def lines_left(rows):
    """By brute force: lines with words that stand in no repeated pair of neighbouring ones."""
    seen, left = set(), {}
    for i, t in rows:
        own = [x for x in t.split("\n") if x.strip()]
        gone = set()
        for k in range(len(own) - 1):
            if (own[k], own[k + 1]) in seen:
                gone |= {k, k + 1}
            seen.add((own[k], own[k + 1]))
        left[i] = [x for k, x in enumerate(own) if k not in gone]
    return left


def test_runs_of_lines_in_other_contexts(spark, tmp_path):
    rng = random.Random(3)
    new = lambda n: [prose(rng, rng.randint(3, 9)) for _ in range(n)]
    rows = []
    for size in (2, 3, 4, 6, 10):
        for _ in range(5):
            block = new(size)
            rows += [(len(rows) + k, "\n".join([*new(rng.randint(0, 5)), *block, *new(rng.randint(0, 5))])) for k in range(3)]
    whole = "\n".join(new(2)) + "\n\n"
    rows += [(len(rows), whole), (len(rows) + 1, whole), (len(rows) + 2, "same\nsame\nsame\nsame"), (len(rows) + 3, "")]
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, stored(spark, tmp_path, rows)).collect()}
    want = lines_left(rows)
    for i, t in rows:
        assert [x for x in got[i].text.split("\n") if x.strip()] == want[i]
        cut = [tuple(map(int, x.split(":"))) for x in got[i].removed.split(",") if x]
        for a, b in reversed(cut):
            t = t[:a] + t[b:]
        assert t == got[i].text
    assert got[rows[-3][0]].text == ""


def sentences_left(sents):
    """By brute force: numbers of the sentences in no repeated run of two or more with 20 words, for documents of plain sentences."""
    seen, left = set(), []
    for own in sents:
        gone, found = set(), set()
        for a in range(len(own)):
            for b in range(a + 2, len(own) + 1):
                run = tuple(own[a:b])
                if sum(len(x.split()) for x in run) >= 20 or (a == 0 and b == len(own)):
                    if run in seen or run in found:
                        gone |= set(range(a, b))
                    found.add(run)
        seen |= found
        left.append([x for k, x in enumerate(own) if k not in gone])
    return left


def test_runs_of_sentences_go_up_to_their_last(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "w" + str(rng.random())[2:9]
    new = lambda sizes: [" ".join(word() for _ in range(n)) + "." for n in sizes]
    some = lambda: new(rng.choices(range(1, 25), k=rng.randint(0, 4)))
    docs = []
    for sizes in ([10, 10, 10, 5], [5, 10, 10, 10], [4, 4, 4], [24, 1, 1], [10, 4, 10], [3, 19, 2, 7, 1, 1]):
        block = new(sizes)
        docs += [block, block, [*some(), *block, *some()], [*some(), *block, *some()]]
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)]
    got = {r.doc_id: r.text for r in queries.op1_substring_dedup(spark, stored(spark, tmp_path, rows)).collect()}
    for k, left in enumerate(sentences_left(docs)):
        assert got[k].split() == " ".join(left).split()
    assert all(got[k] == "" for k in range(1, len(docs), 4))


def test_unpunctuated_passages_behind_lead_ins(spark, tmp_path):
    rng = random.Random(11)
    new = lambda n: ["w" + str(rng.random())[2:9] for _ in range(n)]
    rows, passages = [], {}
    for lead in range(1, 12):
        passage = new(51)
        rows.append((len(rows), " ".join([*new(3), *passage, *new(2)])))
        passages[len(rows)] = passage
        rows.append((len(rows), " ".join([*new(3 + lead), *passage, *new(2)])))
    got = {r.doc_id: r.text.split() for r in queries.op1_substring_dedup(spark, stored(spark, tmp_path, rows)).collect()}
    for i, t in rows:
        kept = got[i]
        if i not in passages:
            assert kept == t.split()
            continue
        left = [k for k, w in enumerate(passages[i]) if w in set(kept)]
        assert all(k < 12 or k > 38 for k in left)
        assert [w for w in t.split() if w not in passages[i]] == [w for w in kept if w not in passages[i]]


def test_items_of_few_plain_words(spark, tmp_path):
    items = [
        (1, "What is 12 * 7?"), (2, "Who is Ada Lovelace?"), (3, "Anna Berta Carla Dora Emma Frida Greta Hanna Ida Jana"), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, "42"),
        (6, "The names are Rome Paris Milan Lyon Turin 12 15 17 and no more than that are asked for here"), (7, ""), (8, None),
    ]
    rows = [(i, f"Some words before. {t} And some after.") for i, t in items if t] + [
        (20, "they asked Who is Ada Lovelace? and went"), (21, "they asked who is ada lovelace and went"), (22, "What is 13 * 7? asked"), (23, "Who is Bob Lovelace?"), (24, "1 2 3 4 5 6 7 9"), (25, ""), (26, None),
    ]
    sf = stored(spark, tmp_path, rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r.item_ids for r in queries.op10_template_decontamination(spark, sf).collect()}
    assert got == {1: "1", 2: "2", 3: "3", 4: "4", 5: "5", 6: "6", 20: "2", 21: "2", 22: "", 23: "", 24: "", 25: "", 26: ""}


@pytest.mark.parametrize("full", ["first", "middle", "last"])
@pytest.mark.parametrize(("form", "other"), [("5552186", ""), ("1-555-2186", " order {0} and 9{0}")])
def test_fifty_repeats_of_a_number(full, form, other):
    rng = random.Random(2)
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    some = [f"and so +1 ({num(3)}) 555-{num(4)} it is a{num(2)}.b@mail.example.com in {rng.randint(1, 250)}.{rng.randint(1, 250)}.3.4 of year {num(4)} or {num(2)}{other.format(num(7))}" for _ in range(200)]
    model = pii_crf.train(some)
    for repeats in (1, 13, 50):
        parts = [f"Again {form} it was; the order of words goes on."] * repeats
        at = {"first": 0, "middle": repeats // 2, "last": repeats}[full]
        text = " ".join([*parts[:at], "Call +1 (456) 555-2186 now.", *parts[at:]])
        base = pii_crf.base_spans(text)
        got = {(a, b) for a, kind, b in pii_crf.added_spans([text], [base], model)[0] if pii_crf.KINDS[kind] == "phone"}
        want = {(m.start() + 6, m.end()) for m in re.finditer("Again " + form, text)}
        assert len(base) == 1 and len(want) == repeats and got == want
