"""Steps that grew faster than the tables: what each does once, and what it holds at once."""

import os
import random
import re

import pytest

import __spark_entry__ as entry
from discloom.operators import fragments as FR, points as PT, search
from pyspark.sql import Window, functions as F

SMALL = entry.SMOKE_DIR
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


@needs_tables
def test_tables_of_evidence_are_searched_once_for_corrections(spark):
    plan = _plan(entry.queries()["disclosure_events"](spark, SMALL))
    assert plan.count("structstojsonevaluator(") == 1


@needs_tables
@pytest.mark.parametrize("name, most", [("html_points", 0), ("element_paths", 1)])
def test_markup_is_read_once(spark, name, most):
    assert _plan(entry.queries()[name](spark, SMALL)).count("mapinarrow") <= most


def test_many_searches_make_no_row_of_each_pair(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_SCORES", 64)
    rnd = random.Random(3)
    vectors = [[rnd.choice([0.5, -1.0, 0.25]) for _ in range(3)] for _ in range(120)] + [None, [1.0, None, 0.0], [1.0], [float("nan"), 0.0, 0.0]]
    points = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>").repartition(3)
    asked = points.where("id % 10 = 0 or id > 118").selectExpr("id as q", "v as w")
    for k in (1, 5, 200):
        pairs = points.crossJoin(asked).where("id <> q").select("q", "id", F.round(search.dot(F.col("v"), F.col("w")), 9).alias("score"))
        want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("rank") <= k)
        got = search.dense_topk_many(points, asked, k, "id", "v", "q", "w")
        assert "join" not in _plan(got)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@needs_tables
def test_modes_read_cells_once(spark):
    assert _plan(entry.queries()["table_stat_mode"](spark, SMALL)).count("relation [") == 1


@needs_tables
def test_completeness_keeps_no_table_of_keys(spark):
    plan = entry.queries()["table_completeness"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortAggregate" in plan


def test_texts_meet_the_model_in_small_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for key in keys:
        spark.conf.unset(key)
    rows = spark.createDataFrame([("h1", "a"), ("h2", "bb"), ("h1", "a")], "text_hash string, contextual_text string")
    found = PT.embed_once(rows, lambda texts: [[float(len(x))] for x in texts])
    assert sorted((r.text_hash, r.vector[0]) for r in found.collect()) == [("h1", 1.0), ("h1", 1.0), ("h2", 2.0)]
    assert [int(spark.conf.get(key)) for key in keys] == [1000, 2 << 20]


@needs_tables
def test_fragments_are_checked_without_joins_and_texts_stay_where_they_are_read(spark):
    plan = entry.queries()["fragment_codes"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan
    dealt = re.findall(r"Exchange .*\n[^A-Za-z]*(?:Union|\(?\d*\)? ?Project) *(.*)", plan)
    assert dealt and not any(x in y for x in ("heading_path", "captions", "text#", "values#", "headers#") for y in dealt)


def _table_faults(tables, records):
    """Faults of one section's tables (place, id, records, width) and records (place, id, index, width), told one by one."""
    out, last, seen = [], {}, []
    for turn, (pos, tid, n, width) in enumerate(tables):
        out += [("duplicate_table_id", str(pos))] if tid in seen else []
        number = re.fullmatch(r"rtable:1:src0:s1:t(\d+)", tid or "")
        out += [("table_id_order", str(pos))] if number and int(number[1]) != turn else []
        seen.append(tid)
        last[tid] = (-1 if n is None else max(n, -1), width)
    own = {}
    for pos, tid, index, width in records:
        if tid is None or tid not in last:
            out.append(("orphan_record", str(pos)))
        else:
            out += [("record_width", str(pos))] if width is not None and width != last[tid][1] else []
            own.setdefault(tid, []).append(index)
    for tid, (n, _) in last.items():
        found = own.get(tid, [])
        out += [("record_count", tid)] if len(found) != n else []
        out += [("record_order", tid)] if len(found) != max(n, 0) or found != list(range(len(found))) else []
    runs = [r[1] for k, r in enumerate(records) if not k or records[k - 1][1] != r[1]]
    asked = [t[1] for t in tables if t[2] is not None and t[2] > 0]
    return out + ([("record_table_order", None)] if runs != asked or None in asked else [])


@pytest.mark.parametrize("most", [100_000, 3])
def test_faults_of_tables_and_records_are_those_told_one_by_one(spark, monkeypatch, most):
    monkeypatch.setattr(FR, "SECTIONS_A_TASK", most)
    rnd, want, evidence, records = random.Random(5), [], [], []
    tid = lambda: rnd.choice([None, "t", *[f"rtable:1:src0:s1:t{k}" for k in (0, 0, 1, 1, 2)], "rtable:1:src0:s1:t99999999999"])
    sections = ["section:1:src0:s1"] + [f"section:1:src0:s1:{k}" for k in range(400)]  # ids out of form leave a table's scope open
    for name in sections:
        tables = [(2 * k, tid(), rnd.choice([None, -4, 0, 1, 1, 2]), rnd.choice([1, 2])) for k in range(rnd.randrange(5))]
        if rnd.random() < 0.5:  # records as the tables ask for them, with a slip now and then
            rows = [[t, i, w] for _, t, n, w in tables for i in range(n or 0)]
            if rows and rnd.random() < 0.5:
                rnd.choice(rows)[rnd.randrange(3)] = rnd.choice([None, 0, 1])
                rows = [[None if t is None else str(t), i, w] for t, i, w in rows]
        else:
            rows = [[tid(), rnd.choice([None, 0, 1, 2]), rnd.choice([None, 1, 2])] for _ in range(rnd.randrange(5))]
        rows = [(pos, *r) for pos, r in enumerate(rows)]
        want += [(name, *f) for f in _table_faults(tables, rows)]
        evidence += [(name, pos, "TABLE", "R_TABLE", "SECTION_RECORDS", t, n, [["h"]] * w) for pos, t, n, w in tables] + [(name, 2 * k + 1, "TEXT", None, None, None, None, None) for k in range(2)]
        records += [(name, pos, t, i, None if w is None else ["v"] * w) for pos, t, i, w in rows]
    typed = lambda rows, names, schema: spark.createDataFrame(rows, ", ".join(f for f in schema.split(", ") if f.split()[0] in names)).repartition(3)
    full = lambda df, schema: df.selectExpr(*[f.split()[0] if f.split()[0] in df.columns else f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in schema.split(", ")])
    e = full(typed(evidence, ("section_id", "pos", "evidence_type", "table_type", "storage_mode", "table_id", "record_count", "headers"), FR.EVIDENCE), FR.EVIDENCE)
    r = full(typed(records, ("section_id", "pos", "table_id", "record_index", "values"), FR.RECORDS), FR.RECORDS)
    got = FR.fragment_faults(spark.createDataFrame([(x,) for x in sections], "section_id string"), e, r).collect()
    codes = {x[1] for x in want}
    assert len(codes) == 7 and sorted(map(str, ((x.section_id, x.code, x["at"]) for x in got if x.code in codes))) == sorted(map(str, want))
    again = {(x.section_id, x["at"]) for x in got if x.code == "duplicate_evidence_id"}  # ids are null here: all but a section's first
    places = {}
    for x in sorted(evidence, key=lambda x: x[1]):
        places.setdefault(x[0], []).append(str(x[1]))
    assert again == {(k, at) for k, v in places.items() for at in v[1:]}


def test_tasks_of_fragments_follow_the_sections(spark):
    assert [FR._tasks(n, 12) for n in (0, 9_000_000, 54_000_000, 150_000_000)] == [12, 90, 200, 300]
