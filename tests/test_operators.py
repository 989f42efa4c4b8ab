"""Packing, resolution, plans, sinks, search and streams."""

import random

import pytest

from discloom.operators import profiling as P, relational as R, search
from discloom.plans.scope import Filter, PlanError, Scope, check_clear, check_selection, conjunction, merged, result_limit, signature
from discloom.sources import sinks
from discloom.streaming import events as E
from pyspark.sql import functions as F


def test_balanced_packing_against_exhaustive_rule():
    rnd = random.Random(3)
    for _ in range(200):
        w = [rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 12))]
        cap = rnd.randrange(8, 20)
        got = P.pack_balanced(w, cap)
        assert [x for g in got for x in g] == list(range(len(w))) and all(sum(w[k] for k in g) <= cap for g in got)
        assert len(got) == len(P.pack_greedy(w, cap))  # greedy runs are as few as can be
        start, left = 0, sum(w)
        for n, g in enumerate(got):
            runs = len(got) - n
            fits = [e for e in range(start + 1, len(w) + 1) if sum(w[start:e]) <= cap and len(P.pack_greedy(w[e:], cap)) <= runs - 1]
            best = min(fits, key=lambda e: (abs(sum(w[start:e]) - left / runs), -sum(w[start:e])))
            assert g[-1] + 1 == best
            start, left = best, left - sum(w[start:best])


def test_byte_chunks():
    assert P.pack_bytes([10, 10], 5, 100, 200) == ([[0, 1]], False)
    assert P.pack_bytes([10, 10], 120, 100, 110) == ([[0, 1]], True)
    assert P.pack_bytes([90, 90], 15, 100, 250) == ([[0, 1]], False)
    groups, over = P.pack_bytes([30, 30, 300, 30, 30, 30], 10, 100, 200)
    assert groups == [[0, 1], [2], [3, 4], [5]] or groups == [[0, 1], [2], [3], [4, 5]] and over


def test_packing_tables_in_spark(spark):
    rows = [(t, p, (p * 7 + t) % 40 + 1) for t in range(30) for p in range(t)]
    got = P.pack_tables(spark.createDataFrame(rows, "t long, p long, s long").repartition(5), "t", "p", "s", "greedy", 60).collect()
    want = {(t, p): k for t in range(30) for k, g in enumerate(P.pack_greedy([(p * 7 + t) % 40 + 1 for p in range(t)], 60)) for p in g}
    assert {(r.t, r.p): r.chunk_index for r in got} == want
    nulls = [(None, p, 30) for p in range(3)] + [(1, 0, 30), (2, 0, 500)]
    got = P.pack_tables(spark.createDataFrame(nulls, "t long, p long, s long").repartition(4), "t", "p", "s", "bytes", 100).collect()
    assert {(r.t, r.p): (r.chunk_index, r.chunk_count, r.overflow) for r in got} == {(None, 0): (0, 1, False), (None, 1): (0, 1, False), (None, 2): (0, 1, False), (1, 0): (0, 1, False), (2, 0): (0, 1, True)}


def test_correction_cascade(spark):
    s = "src string, receipt string, original_date string, doc_group string, company string, name string, family string"
    c = "receipt string, submitted string, doc_group string, company string, name string, family string"
    z = lambda n: f"{n:014d}"
    cands = [(z(1), "d1", "g", "A", "n1", "f1"), (z(2), "d1", "g", "A", "n2", "f1"), (z(3), "d1", "g", "B", "n1", "f2"), (z(4), "d2", None, "A", "n9", "f9"), (z(9), "d1", "g", "A", "n1", "f1")]
    asks = {
        "exact": (z(5), "d1", "g", "A", "n1", "f1"), "later": (z(1), "d1", "g", "A", "n1", "f1"), "nodate": (z(5), None, "g", "A", "n1", "f1"), "group": (z(5), "d1", "h", "A", "n1", "f1"),
        "company": (z(5), "d1", "g", "C", "n1", "f1"), "family": (z(5), "d1", "g", "B", "zz", "f2"), "kin": (z(5), "d1", "g", "A", "zz", "f1"), "sole": (z(5), "d2", "g", "A", "zz", "zz"), "nokey": (z(5), "d2", "g", None, "zz", "f9"),
    }
    got = {r.src: (r.code, r.target) for r in R.resolve_corrections(spark.createDataFrame([(k, *v) for k, v in asks.items()], s), spark.createDataFrame(cands, c)).collect()}
    assert got == {
        "exact": ("EXACT", z(1)), "later": ("DATE_NOT_FOUND", None), "nodate": ("NOT_RESOLVED", None), "group": ("GROUP_MISMATCH", None), "company": ("COMPANY_MISMATCH", None),
        "family": ("DOCUMENT_FAMILY_RECOVERED", z(3)), "kin": ("AMBIGUOUS", None), "sole": ("UNIQUE_CANDIDATE_RECOVERED", z(4)), "nokey": ("DOCUMENT_FAMILY_RECOVERED", z(4)),
    }


def test_lookup_must_be_total(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        R.total_lookup(left, right, ["k"], "v").collect()


def test_plans():
    with pytest.raises(PlanError):
        Filter("a", bounds={"gt": 1})
    with pytest.raises(PlanError):
        Filter("a")
    with pytest.raises(PlanError):
        merged([Filter("a", 1), Filter("a", 2)])
    assert merged([Filter("a", 1), Filter("a", any_of=(1, 2))], {"a"})[0].any_of == (1, 2)
    assert signature([Filter("b", 1), Filter("a", any_of=(2, 1))]) == signature([Filter("a", any_of=(1, 2)), Filter("b", 1)])
    with pytest.raises(PlanError):
        Scope("COMPANY")
    assert [result_limit("SECTION"), result_limit("GLOBAL", ["TREND"]), result_limit("SECTION", previous=[18], expand=True), result_limit("GLOBAL", ids=4)] == [3, 15, 20, 4]
    with pytest.raises(PlanError):
        check_clear(["AMOUNT"], ["x"], [])
    for bad in (("COMPLETE", [], {}), ("PARTIAL", ["r", "r"], {"r": "SUCCESS"}), ("PARTIAL", ["r"], {"r": "FAILED"})):
        with pytest.raises(PlanError):
            check_selection(*bad)


def test_sinks(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, v string, w int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k int, v string, w int")
    assert sorted(map(tuple, sinks.upsert(base, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    for rows in ([(1, "x"), (2, "x")], [(1, "y")]):
        sinks.write_partitioned(spark.createDataFrame(rows, "p int, v string"), str(tmp_path / "t"), ["p"])
    assert sorted((r.p, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "y"), (2, "x")]
    sinks.write_jsonl(base, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).where("value like '%null%'").count() == 1


def test_search(spark):
    points = spark.createDataFrame([(i, [float(i == k) for k in range(3)], i % 2) for i in range(3)], "id long, v array<float>, tag int")
    assert [(r.id, r["rank"]) for r in search.dense_topk(points, [0.9, 0.5, 0.1], 2, "id", "v").orderBy("rank").collect()] == [(0, 1), (1, 2)]
    assert [r.id for r in search.dense_topk(points, [0.9, 0.5, 0.1], 2, "id", "v", F.col("tag") == 1).collect()] == [1]
    a, b = (spark.createDataFrame(x, "id long, rank long") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)]))
    assert [r.id for r in search.fuse([a, b], 2, "id").orderBy("rank").collect()] == [2, 1]
    assert [r.id for r in search.fuse([a, b], 2, "id", threshold=0.02).collect()] == [2]
    with pytest.raises(ValueError):
        search.dense_topk_many(points, points.selectExpr("id q", "v w"), 1, "id", "v", "q", "w", most=2)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 4} 00:00:00", i % 3, "error", 1.0, "{}") for i in range(12)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in range(3):
        frame.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    E.keep_latest(E.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.user_id, r.event_id) for r in E.latest(spark, str(tmp_path / "out")).collect()) == [(0, 9), (1, 10), (2, 11)]
    kept = sorted(p.parent.name for p in (tmp_path / "out").rglob("_bucket=*"))
    assert len(kept) <= 6 and "2" in kept
    counts = E.windowed_counts(E.distinct_events(E.read_events(spark, str(tmp_path / "in"), 10)), lateness=None)
    counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start().awaitTermination()
    assert spark.table("counts").count() >= 1
