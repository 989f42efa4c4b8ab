"""Boilerplate lines against brute force."""

import random
from collections import Counter

from discloom.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, source string, n_lines string, host string"


def brute(rows, ratio, least):
    pages = Counter(r[2] for r in rows)
    n = Counter()
    for r in rows:
        n.update({(r[2], x.strip(" \t\r")) for x in (r[1].split("\n") if r[1] is not None else [])})
    bad = {k for k, c in n.items() if k[1] and c >= least and c > ratio * pages[k[0]]}
    return sorted((r[0], r[1] if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[2], x.strip(" \t\r")) not in bad)) for r in rows)


def test_equals_brute_force(spark):
    rnd = random.Random(7)
    lines = ["menu", " menu ", "é", "", " ", "\t", "a\\b", "$"] + [f"body {i}" for i in range(200)]
    rows = [(i, "\n".join(rnd.choices(lines[:8], k=2) + rnd.choices(lines, k=rnd.randrange(9))), rnd.choice(["a", "a", "a", "b", "", None]), "x", "y") for i in range(300)]
    rows += [(900, None, "a", None, None), (901, "", "a", None, None), (902, "menu", "solo", None, None), (903, "menu\nmenu", "a", None, None), (903, "menu\nmenu", "a", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = dedup_lines(frame, max_ratio=0.1)
    assert got.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == brute(rows, 0.1, 3)
    counted = dedup_lines(frame, max_ratio=0.1, counts=True).where("doc_id in (900, 902, 903)").collect()
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in counted) == [(900, None, 0, 0), (902, "menu", 1, 0), (903, "", 2, 2), (903, "", 2, 2)]


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_texts(spark):
    rows = [(k, "menu\n" + "\n".join(f"{k} line {i}" for i in range(20_000)) + "\n" + "w" * 1_000_000, "a", None, None) for k in range(4)]
    assert sorted((r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows, 0.08, 3)
