"""Structural checks of fragments: a section's evidence and the records of its tables, each fault a row (section_id, code, at).

Three tables hold the fragments of any number of sections:
evidence: section_id, pos, evidence_id, ord, evidence_type, table_type, storage_mode, text, text_role, captions, heading_path, fields, table_id, record_count, headers;
records: section_id, pos, table_id, record_index, row_type, row_context, values.
Types are the schema's business; what is checked here is what a schema can't say. `at` is the place in the list, or a table's id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from discloom.operators.validation import all_violations, violations

#: Fixed patterns and values: ids of sections, evidence and tables, roles of texts, types of rows.
SECTION_ID = r"^section:(\d+):src(\d+):s(\d+)$"
EVIDENCE_ID = r"^evidence:(\d+):src(\d+):s(\d+):e(\d+)$"
TABLE_ID = r"^rtable:(\d+):src(\d+):s(\d+):t(\d+)$"
TEXT_ROLES = ("BODY", "NOTE", "REFERENCE_NOTICE")
ROW_TYPES = ("DATA", "SUBTOTAL", "TOTAL", "UNKNOWN")
#: Sections of a task that sorts their keys. To more than PLAIN_TASKS (spark.shuffle.sort.bypassMergeThreshold) Spark deals rows by a writer
#: that holds them in memory; so tasks stay that many until each would have MOST_SECTIONS.
SECTIONS_A_TASK, PLAIN_TASKS, MOST_SECTIONS = 100_000, 200, 500_000

EVIDENCE = (
    "section_id string, pos int, evidence_id string, ord int, evidence_type string, table_type string, storage_mode string, text string, text_role string, captions array<string>, heading_path array<string>, "
    "fields array<string>, table_id string, record_count int, headers array<array<string>>"
)
RECORDS = "section_id string, pos int, table_id string, record_index int, row_type string, row_context array<string>, values array<string>"


def _scope(x: str, pattern: str) -> Column:
    return F.array(*[F.regexp_extract(x, pattern, k) for k in (1, 2, 3)])


def _filled(x: str) -> Column:
    """Null, or a list of texts with something in each."""
    return F.col(x).isNull() | ((F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(F.trim(v) != "", F.lit(False))))


def _matches(x: str, pattern: str) -> Column:
    return F.coalesce(F.col(x).rlike(pattern), F.lit(False))


def fragment_faults(sections: DataFrame, evidence: DataFrame, records: DataFrame) -> DataFrame:
    """section_id, code, at of every fault. sections: section_id of each fragment.

    What a row shows by itself is told where it is read. Only keys, places and sizes are shuffled for the rest, to as many tasks as
    SECTIONS_A_TASK asks for.
    """
    section_ok = _matches("section_id", SECTION_ID)
    text, table = F.col("evidence_type") == "TEXT", F.col("evidence_type") != "TEXT"
    kind = F.coalesce("table_type", F.lit(""))
    stored = table & (kind != "KV_TABLE") & F.col("storage_mode").eqNullSafe("SECTION_RECORDS")
    same = lambda x, pattern: ~section_ok | ~_matches(x, pattern) | (_scope(x, pattern) == _scope("section_id", SECTION_ID))
    scoped = _matches("table_id", TABLE_ID) & same("table_id", TABLE_ID)
    rules = {
        "evidence_id": _matches("evidence_id", EVIDENCE_ID), "evidence_id_scope": same("evidence_id", EVIDENCE_ID), "evidence_order": F.col("ord").eqNullSafe(F.col("pos")),
        "evidence_type": F.col("evidence_type").isin("TEXT", "TABLE"), "heading_path": _filled("heading_path"),
        "text_payload": table | (F.coalesce(F.trim("text"), F.lit("")) != ""), "text_role": table | F.col("text_role").isNull() | F.col("text_role").isin(*TEXT_ROLES),
        "captions": text | (_filled("captions") & (F.col("captions").isNull() | (F.size(F.array_distinct("captions")) == F.size("captions")))), "table_text_role": text | F.col("text_role").isNull(),
        "table_type": text | kind.isin("KV_TABLE", "R_TABLE"), "kv_storage_mode": text | (kind != "KV_TABLE") | F.col("storage_mode").isNull(), "kv_payload": text | (kind != "KV_TABLE") | F.col("fields").isNotNull(),
        "r_table_storage_mode": text | (kind == "KV_TABLE") | stored, "table_id": ~stored | _matches("table_id", TABLE_ID), "table_id_scope": ~stored | ~_matches("table_id", TABLE_ID) | same("table_id", TABLE_ID),
        "record_count_value": ~stored | (F.col("record_count") >= 0), "headers": ~stored | (F.col("headers").isNotNull() & F.forall("headers", lambda h: h.isNotNull() & F.forall(h, lambda p: p.isNotNull()))),
    }
    row_rules = {
        "record_index": F.col("record_index") >= 0, "row_type": F.col("row_type").isin(*ROW_TYPES),
        "row_context": F.col("row_context").isNotNull() & F.forall("row_context", lambda v: v.isNotNull()), "values": F.col("values").isNotNull() & F.forall("values", lambda v: v.isNotNull()),
    }
    at = lambda df: df.select("section_id", "code", F.col("pos").cast("string").alias("at"))
    bad_sections = sections.where(~section_ok).select("section_id", F.lit("section_id").alias("code"), F.lit(None).cast("string").alias("at"))

    tasks = _tasks(sections.count(), int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = evidence.select("section_id", "evidence_id", "pos").repartition(tasks, "section_id", "evidence_id")
    again = ids.withColumn("_nth", F.row_number().over(Window.partitionBy("section_id", "evidence_id").orderBy("pos"))).where("_nth > 1").select("section_id", F.lit("duplicate_evidence_id").alias("code"), "pos")

    place = F.when(scoped, F.coalesce(F.regexp_extract("table_id", TABLE_ID, 4).try_cast("int"), F.lit(-1)))
    tables = evidence.where(stored).select("section_id", "table_id", F.lit(0).alias("kind"), "pos", F.coalesce("record_count", F.lit(-1)).alias("n"), F.coalesce(F.size("headers"), F.lit(0)).alias("width"), place.alias("place"))
    rows = records.select("section_id", "table_id", F.lit(1).alias("kind"), "pos", F.col("record_index").alias("n"), F.when(F.col("values").isNotNull(), F.size("values")).alias("width"), F.lit(None).cast("int").alias("place"))
    met = _table_faults(tables.unionAll(rows).repartition(tasks, "section_id"))
    return all_violations([bad_sections, at(violations(evidence, ["section_id", "pos"], rules)), at(again), at(violations(records, ["section_id", "pos"], row_rules)), met])


def _tasks(n_sections: int, least: int) -> int:
    return max(least, min(-(-n_sections // SECTIONS_A_TASK), PLAIN_TASKS), -(-n_sections // MOST_SECTIONS))


def _table_faults(rows: DataFrame) -> DataFrame:
    """Faults between the tables of a section (kind 0; n records of a width, place as its id tells) and its records (kind 1; n is the index).

    Rows are dealt by section_id and sorted three times, without a join or a table of keys: by list, by turn and by table.
    """
    listed, order = Window.partitionBy("section_id", "kind").orderBy("pos"), Window.partitionBy("section_id", "table_id").orderBy("kind", "pos")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_table, is_record, keyed = F.col("kind") == 0, F.col("kind") == 1, F.col("section_id").isNotNull() & F.col("table_id").isNotNull()
    # a turn is a table that asks for records, or a run of records of one table: the nth of one kind must meet the nth of the other
    starts = F.coalesce(~F.col("table_id").eqNullSafe(F.lag("table_id").over(listed)), F.lit(True)) | F.lag("pos").over(listed).isNull()
    df = rows.withColumns({"_no": F.row_number().over(listed) - 1, "_starts": starts}).withColumn("_starts", F.when(is_table, F.col("n") > 0).otherwise(F.col("_starts")))
    df = df.withColumn("_turn", F.when(F.col("_starts"), F.sum(F.col("_starts").cast("int")).over(so_far(listed))))
    turn, own = Window.partitionBy("section_id", "_turn").orderBy("kind"), F.col("table_id")
    alone = ~F.coalesce(own == F.lag("table_id").over(turn), F.lit(False)) & ~F.coalesce(own == F.lead("table_id").over(turn), F.lit(False))
    df = df.withColumn("_alone", alone).withColumn("_alone", F.col("_starts") & (F.col("_alone") | F.col("section_id").isNull()))
    # a table's rows stand before its records; the last of an id tells what its records should be, dense from 0 in list order
    told = F.last(F.when(is_table, F.struct("n", "width")), ignorenulls=True).over(so_far(order))
    df = df.withColumns({"_nth": F.row_number().over(order), "_t": told, "_found": F.sum("kind").over(so_far(order)), "_ends": F.lead("kind").over(order).isNull()})
    df = df.withColumn("_dense", F.min(is_table | ~keyed | F.col("n").eqNullSafe(F.col("_found") - 1)).over(so_far(order)))
    section = Window.partitionBy("section_id")
    df = df.withColumns({"_torn": F.max("_alone").over(section), "_first": F.lag("kind").over(section.orderBy("table_id", "kind", "pos")).isNull()})

    known, counted = F.col("_t").isNotNull() & keyed, F.col("_ends") & F.col("_t").isNotNull()
    found, asked = F.when(keyed, F.col("_found")).otherwise(0), F.greatest("_t.n", F.lit(-1))
    pos, none = F.col("pos").cast("string"), F.lit(None).cast("string")
    faults = {
        "table_id_order": (is_table & (F.col("place") != F.col("_no")), pos), "duplicate_table_id": (is_table & (F.col("_nth") > 1), pos),
        "orphan_record": (is_record & ~known, pos), "record_width": (is_record & known & (F.col("width") != F.col("_t.width")), pos),
        "record_count": (counted & (found != asked), own), "record_order": (counted & ~((found == F.greatest(asked, F.lit(0))) & F.col("_dense")), own),
        "record_table_order": (F.col("_first") & F.col("_torn"), none),
    }
    seen = F.array_compact(F.array(*[F.when(is_so, F.struct(F.lit(code).alias("code"), where.alias("at"))) for code, (is_so, where) in faults.items()]))
    return df.select("section_id", F.inline(seen))


def forbidden_names(schema_names: Sequence[str]) -> list[str]:
    """Fields that a fragment must not carry: its document's own facts."""
    return sorted(set(schema_names) & FORBIDDEN)


#: Facts of the document and traces of its making, which a fragment must not repeat.
FORBIDDEN = {
    "doc_id", "rcept_no", "doc_group", "source_index", "source_path", "source_sha256", "canonical_section_path", "canonical_section_sha256",
    "source_refs", "content_sha256", "markdown", "context", "source_block_order", "source_row", "source_cell", "column_id",
}
