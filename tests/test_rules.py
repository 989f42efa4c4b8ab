"""What must be refused, and the edges of chains: empty tables, cycles, flags on some rows alone."""

import uuid
from dataclasses import asdict

import pytest

from discloom.functions import numeric as N, text as X
from discloom.operators import fragments as FR, points as PT, profiling as P, projections as PR, relational as R, statistics as S
from discloom.sources import sinks
from pyspark.sql import functions as F


def test_rules_of_profiles_come_from_a_file(tmp_path):
    import yaml

    told = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(P.ProfileRules(values_per_column=7, date_words=("날",))).items()}
    path = tmp_path / "rules.yaml"
    path.write_text(yaml.safe_dump(told, allow_unicode=True), encoding="utf-8")
    rules = P.ProfileRules.read(str(path))
    assert rules.values_per_column == 7 and rules.date_words == ("날",)
    for wrong in ({**told, "more": 1}, {k: v for k, v in told.items() if k != "date_words"}, {**told, "date_ratio": 2.0}, {**told, "values_per_table": 0}, {**told, "date_words": []}):
        path.write_text(yaml.safe_dump(wrong, allow_unicode=True), encoding="utf-8")
        with pytest.raises(ValueError):
            P.ProfileRules.read(str(path))


def test_promotion_is_asked_for(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/candidate")
    spark.range(9).write.parquet(f"{tmp_path}/golden")
    with pytest.raises(ValueError):
        sinks.promote(spark, f"{tmp_path}/candidate", f"{tmp_path}/golden")
    sinks.promote(spark, f"{tmp_path}/candidate", f"{tmp_path}/golden", approved=True)
    assert spark.read.parquet(f"{tmp_path}/golden").count() == 3


def test_scopes_flags_and_cycles_are_refused(spark):
    rows = lambda *x: spark.createDataFrame(x, "k string, n string")
    universe = rows(("a", "A"), ("b", "B"))
    assert R.checked_scope(rows(("a", "A")), universe, "k", "n").count() == 1
    for pilot in (rows(("z", "Z")), rows(("a", "B"))):
        with pytest.raises(Exception, match="universe"):
            R.checked_scope(pilot, universe, "k", "n").collect()
    flags = spark.createDataFrame([("d1", True), ("d2", None)], "doc string, is_latest_version boolean")
    chain = spark.createDataFrame([("d1", "d2")], "root string, receipt string")
    with pytest.raises(ValueError):
        R.latest_by_flag(flags, chain, "doc", "root", "receipt")
    plain = flags.withColumn("is_latest_version", F.lit(None).cast("boolean"))
    assert {r.doc: r.is_latest for r in R.latest_by_flag(plain, chain, "doc", "root", "receipt").collect()} == {"d1": False, "d2": True}
    with pytest.raises(ValueError):
        R.closure(rows(("a", "b"), ("b", "a")), "k", "n", most=5)
    assert R.closure(rows(("a", "b")).limit(0), "k", "n").count() == 0
    with pytest.raises(ValueError):
        S.combine_all("ratio", F.array(), F.array(), F.lit(True))


def test_fragments_without_rows(spark):
    sections = spark.createDataFrame([("section:1:src0:s1",), ("bad",)], "section_id string")
    none, bare = spark.createDataFrame([], FR.EVIDENCE), spark.createDataFrame([], FR.RECORDS)
    assert [(r.section_id, r.code) for r in FR.fragment_faults(sections, none, bare).collect()] == [("bad", "section_id")]
    assert FR.fragment_faults(sections.limit(0), none, bare).collect() == []
    assert FR.forbidden_names(["text", "rcept_no", "markdown"]) == ["markdown", "rcept_no"]


def test_names_and_cells(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(X.uuid5(PT.NAMESPACE, F.lit("1:0:0:whole"))) == str(uuid.uuid5(uuid.UUID(PT.NAMESPACE), "1:0:0:whole"))
    assert one(X.document_family(F.lit("[정정] 분기보고서(제3기)"))) == "분기보고서" and one(X.document_family(F.lit(None).cast("string"))) is None
    cells = ["12 KG", "(1,234원)", "△5", "5 %", "2024 q3", "20240101", "2150", "２０２４", "12개", "1,23", "abc 1"]
    flags = [tuple(one(rule(F.lit(c))) for rule in (N.is_numeric_cell, N.is_date_cell, N.is_year_cell, N.is_percent_cell)) for c in cells]
    t, f = True, False
    assert flags == [(t, f, f, f), (t, f, f, f), (t, f, f, f), (t, f, f, t), (f, t, f, f), (t, t, f, f), (t, f, t, f), (t, f, f, f), (t, f, f, f), (f, f, f, f), (f, f, f, f)]
    assert one(PR.error_class(F.array().cast("array<string>"), F.array().cast("array<string>"))) == "ERROR"


def test_a_batch_of_a_stream_can_run_again(spark, tmp_path):
    from discloom.streaming.events import _Store

    for n, own in ((0, [1, 2]), (1, [2]), (3, [1])):
        spark.createDataFrame([(b, n) for b in own], "_bucket int, v int").write.partitionBy("_bucket").parquet(f"{tmp_path}/{n}")
    store = _Store(spark, str(tmp_path))
    assert store.newest() == {1: 3, 2: 1} and store.newest(before=3) == {1: 0, 2: 1}
    store.drop_replaced(3)
    assert store.folders() == {0: [1], 1: [2], 3: [1]} and store.newest(before=3) == {1: 0, 2: 1}
