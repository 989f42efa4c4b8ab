"""Benchmark hits against brute force, by the automaton and by the window join."""

import hashlib
import random
import re

import pytest

from discloom.llm.decontaminate import drop_contaminated, find_contamination

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def brute(docs, items):
    out = {}
    for doc_id, text, *_ in docs:
        w, hit, owners = words(text), set(), []
        for item_id, item in items:
            v = words(item)
            size = min(10, len(v))
            wins = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            at = [k for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in wins] if v else []
            for k in at:
                hit.update(range(k, k + size))
            if at:
                owners.append(str(item_id))
        out[doc_id] = (len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_equals_brute_force(spark, limit):
    rnd = random.Random(3)
    pool = [f"w{i}" for i in range(9)] + ["Über", "x's", "é"]
    items = [(i, " ".join(rnd.choices(pool, k=rnd.choice([1, 4, 9, 10, 11, 30])))) for i in range(30)]
    items += [(50, None), (51, "..."), (52, items[3][1]), (100, "Solo")]
    docs = []
    for i in range(60):
        w = rnd.choices(pool + ["other", "z"], k=rnd.choice([0, 3, 50, 200]))
        for _ in range(rnd.choice([0, 1, 3])):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = words(rnd.choice(items[5:30])[1])[rnd.choice([0, 1]) :]
        docs.append((i, rnd.choice([" ", ", ", "\n--"]).join(w).upper() if i % 3 else " ".join(w), "src", 1))
    docs += [(90, None, None, None), (91, "", None, None), (92, "Hi, SOLO!", None, None), (93, "solow", None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, n_words int")
    got = find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    assert {r.doc_id: tuple(r[1:6]) for r in got} == brute(docs, items)
    text = {d[0]: d[1] for d in docs}
    for r in got:
        assert sum(len(words(text[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    assert [text[92][s.start : s.end] for r in got if r.doc_id == 92 for s in r.spans] == ["SOLO"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r[:4]) for r in find_contamination(docs, items).collect()] == [(1, 2, 0, 0)]
    assert find_contamination(docs.limit(0), items).collect() == []


def test_long_and_repeated_rows(spark):
    item = " ".join(f"q{k}" for k in range(12))
    long = "x " * 400_000 + item.upper() + "!" + " y" * 400_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, item), (2, "clean")], "doc_id long, text string").selectExpr("*", "'a' as row", "array('z') as names", "1 as n_items")
    items = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    for limit in (1 << 20, 10):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in find_contamination(docs, items, limit=limit).collect())
        assert got == [("1", 800_012, 12, 2, True)] * 2 + [("2", 1, 0, 0, False), ("None", 12, 12, 2, True)]
        assert [tuple(r) for r in drop_contaminated(docs, items, limit=limit).collect()] == [(2, "clean", "a", ["z"], 1)]
