"""Column statistics and combinations of results, with reason codes in place of bare nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from discloom.functions.numeric import parse_numeric_cell

OPERATIONS = ("sum", "mean", "median", "max", "min", "mode", "stdev")
OK, BAD = "SUCCESS", "INVALID_INPUT"


def _result(df: DataFrame, keys: list[str], stage: Column, value: Column, unit: Column) -> DataFrame:
    good = stage.isNull()
    return df.select(
        *keys, F.when(good, OK).otherwise(BAD).alias("status"), stage.alias("failure_stage"), F.when(good, value).cast("double").alias("value"),
        F.when(good, unit).alias("unit"), F.when(good, F.col("n")).otherwise(0).cast("long").alias("input_count"),
    )


def column_statistic(cells: DataFrame, keys: list[str], cell: str, op: str, selected: Column | None = None, table_unit: Column | None = None) -> DataFrame:
    """One statistic of a text column for each group: status, failure_stage, value, unit, input_count.

    Checks in order: a missing cell in a selected row or unreadable text (numeric_parsing), more than one unit among
    cells or, where no cell has one, among tables (unit_check), nothing left (numeric_parsing), a tied mode or a
    deviation of fewer than two values (calculation). Missing cells of whole columns are passed over.
    One aggregation computes all of it; the mode's ties need one before it, by (group, value).
    """
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op}")
    rows = cells.select(*keys, parse_numeric_cell(F.col(cell)).alias("p"), (F.lit(False) if selected is None else selected).alias("picked"), (F.lit(None).cast("string") if table_unit is None else table_unit).alias("tu"))
    rows = rows.select(*keys, "p.*", "picked", "tu")
    value = {
        "sum": F.sum("value"), "mean": F.avg("value"), "median": F.median("value"), "max": F.max("value"), "min": F.min("value"), "stdev": F.stddev_samp("value"), "mode": F.lit(None).cast("double"),
    }[op]
    bad = F.count_if(F.col("is_invalid") | (F.col("is_missing") & F.col("picked")))
    units, tables = F.min("unit"), F.min("tu")
    if op == "mode":
        # cells are read once: everything is counted by value first, then added up
        per = rows.groupBy(*keys, "value").agg(F.count("value").alias("c"), bad.alias("bad"), units.alias("u"), F.max("unit").alias("u_last"), tables.alias("t"), F.max("tu").alias("t_last"))
        often = lambda x: F.max(F.when(F.col("value").isNotNull(), F.struct("c", x.alias("value"))))
        out = per.groupBy(*keys).agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.min("u").alias("u"), F.max("u_last").alias("u_last"), F.min("t").alias("t"), F.max("t_last").alias("t_last"),
            often(F.col("value")).alias("top"), often(-F.col("value")).alias("low"),
        )
        out = out.select(
            *keys, "n", F.col("top.value").cast("double").alias("v"), "bad", (F.col("u") != F.col("u_last")).alias("mixed"), "u", (F.col("t") != F.col("t_last")).alias("tables_mixed"), "t",
            (F.col("top.value") != -F.col("low.value")).alias("tied"),
        )
    else:
        out = rows.groupBy(*keys).agg(
            F.count("value").alias("n"), value.cast("double").alias("v"), bad.alias("bad"), (units != F.max("unit")).alias("mixed"), units.alias("u"), (tables != F.max("tu")).alias("tables_mixed"), tables.alias("t"),
        )
    fails = F.col("tied") if op == "mode" else (F.col("n") < 2) if op == "stdev" else F.lit(False)
    stage = (
        F.when(F.col("bad") > 0, "numeric_parsing").when(F.col("mixed"), "unit_check").when(F.col("u").isNull() & F.col("tables_mixed"), "unit_check")
        .when(F.col("n") == 0, "numeric_parsing").when(fails, "calculation")
    )
    return _result(out, keys, stage, F.col("v"), F.coalesce("u", "t"))


def unit_agreement(cells: DataFrame, keys: list[str], unit: str, table_unit: str) -> DataFrame:
    """The one explicit unit of each group, or the tables' one; conflict says that there is more than one."""
    cell, table = F.array_sort(F.collect_set(unit)), F.array_sort(F.collect_set(table_unit))
    out = cells.groupBy(*keys).agg(cell.alias("cell"), table.alias("table"))
    conflict = (F.size("cell") > 1) | ((F.size("cell") == 0) & (F.size("table") > 1))
    return out.select(*keys, F.when(~conflict, F.coalesce(F.get("cell", F.lit(0)), F.get("table", F.lit(0)))).alias("unit"), conflict.alias("conflict"))


def same_unit(a: Column, b: Column) -> Column:
    """Combination is strict: null agrees with null alone."""
    return a.eqNullSafe(b)


def combine(op: str, a: Column, b: Column, periods: Column | None = None, unit_a: Column | None = None, unit_b: Column | None = None) -> Column:
    """struct(status, failure_stage, value, unit) of two operands.

    difference a - b, ratio a / b (no unit), percent_ratio, percent_change from a to b, cagr over periods; sum and mean.
    Units come first, then the operation's own conditions.
    """
    unit_a = F.lit(None).cast("string") if unit_a is None else unit_a
    unit_b = F.lit(None).cast("string") if unit_b is None else unit_b
    x, y = a.cast("double"), b.cast("double")
    never = F.lit(False)
    value, bad, unit = {
        "sum": lambda: (x + y, never, unit_a), "mean": lambda: ((x + y) / 2, never, unit_a), "difference": lambda: (x - y, never, unit_a),
        "ratio": lambda: (F.try_divide(x, y), y == 0, F.lit(None).cast("string")), "percent_ratio": lambda: (F.try_divide(x, y) * 100, y == 0, F.lit("%")),
        "percent_change": lambda: (F.try_divide(y - x, x) * 100, x == 0, F.lit("%")),
        "cagr": lambda: ((F.pow(F.try_divide(y, x), 1 / periods) - 1) * 100, (x <= 0) | (y <= 0) | (periods < 1), F.lit("%")),
    }[op]()
    stage = F.when(x.isNull() | y.isNull(), "structural").when(~same_unit(unit_a, unit_b), "unit_check").when(bad, "calculation")
    good = stage.isNull()
    return F.struct(F.when(good, OK).otherwise(BAD).alias("status"), stage.alias("failure_stage"), F.when(good, value).alias("value"), F.when(good, unit).alias("unit"))


def ordering(df: DataFrame, keys: list[str], value: str, position: str, descending: bool = True) -> DataFrame:
    """rank 1..n within keys; ties keep their input order in both directions."""
    first = F.col(value).desc() if descending else F.col(value).asc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(first, F.col(position).asc())).cast("long"))


def completeness(chunks: DataFrame, key: str, index: str, count: str, start: str, end: str, rows: str) -> DataFrame:
    """The first thing wrong with each chunked table, null if it is whole.

    Checked in order: chunk_count (at least 2, the same), index_range, repeated_index, missing_index, row_start (first 0),
    row_range (length is not the rows it holds), contiguity (each start is the last end + 1).
    """
    order = Window.partitionBy(key).orderBy(index, start)
    new = ~F.col(index).eqNullSafe(F.lag(index).over(order)) & F.col(index).isNotNull()
    line = chunks.withColumns({"gap": F.coalesce(F.col(start) != F.lag(end).over(order) + 1, F.lit(False)), "_new": new})
    # a struct's maximum makes it an aggregation of rows as sorted by the window, without a table of keys in memory
    out = line.groupBy(key).agg(
        F.count("*").alias("n"), F.min(count).alias("lo"), F.max(count).alias("hi"), F.min(index).alias("first"), F.max(index).alias("last"), F.count_if("_new").alias("distinct"),
        F.min(start).alias("start"), F.bool_or(F.col(end) - F.col(start) + 1 != F.col(rows)).alias("length"), F.max(F.struct("gap")).alias("gaps"),
    ).withColumn("gap", F.col("gaps.gap"))
    reason = (
        F.when((F.col("lo") < 2) | (F.col("lo") != F.col("hi")), "chunk_count").when((F.col("first") < 0) | (F.col("last") >= F.col("hi")), "index_range")
        .when(F.col("distinct") < F.col("n"), "repeated_index").when(F.col("distinct") < F.col("hi"), "missing_index").when(F.col("start") != 0, "row_start")
        .when(F.col("length"), "row_range").when(F.col("gap"), "contiguity")
    )
    return out.select(key, reason.isNull().alias("complete"), reason.alias("reason"))


def select_rows(rows: DataFrame, label: str, wanted: DataFrame, wanted_label: str, wanted_pos: str) -> DataFrame:
    """Rows whose trimmed label is asked for, in the order asked; all or nothing.

    status is OK only if each wanted label meets exactly one row and no row's label is unreadable (null).
    """
    known = rows.withColumn("_label", F.trim(label))
    per = known.groupBy("_label").agg(F.count("*").alias("hits"))
    asked = wanted.select(F.trim(wanted_label).alias("_label"), F.col(wanted_pos).alias("position"))
    unreadable = rows.agg(F.count_if(F.col(label).isNull()).alias("unreadable"))
    state = asked.join(per, "_label", "left").agg(F.bool_and(F.coalesce("hits", F.lit(0)) == 1).alias("exact")).crossJoin(unreadable)  # one row each
    met = asked.join(known, "_label").crossJoin(state)
    return met.where(F.col("exact") & (F.col("unreadable") == 0)).drop("_label", "exact", "unreadable")


def selected_rows(rows: DataFrame, keys: list[str], label: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that a selector picks, keys where it can't). wanted: keys and `wanted`, a label that must meet exactly one row.

    Groups that wanted doesn't name keep all their rows. One label without its one row, or an unreadable (null) label, voids its group.
    """
    asked = wanted.select(*keys, F.trim("wanted").alias("_label")).distinct()
    named = asked.select(*keys).distinct().withColumn("_asked", F.lit(True))
    known = rows.withColumn("_label", F.trim(label))
    hits = known.groupBy(*keys, "_label").agg(F.count("*").alias("_hits"))
    lost = asked.join(hits, [*keys, "_label"], "left").where(~F.col("_hits").eqNullSafe(F.lit(1))).select(*keys)
    blind = known.where(F.col("_label").isNull()).join(named, keys, "left_semi").select(*keys)
    picked = known.join(named, keys, "left").join(asked.withColumn("_own", F.lit(True)), [*keys, "_label"], "left")
    picked = picked.where("_asked is null or _own is not null").withColumn("picked", F.col("_asked").isNotNull()).drop("_label", "_asked", "_own")
    return picked, lost.unionAll(blind).distinct()


def table_statistic(chunks: DataFrame, cells: DataFrame, wanted: DataFrame, key: str, op: str) -> DataFrame:
    """A statistic of one column of each table, the whole path: status, failure_stage, value, unit, input_count.

    chunks: key, index, count, start, end, rows. cells: key, label, cell, unit (the table's), cited (has the row a source?).
    wanted: key and wanted, the labels asked for, where only some rows count. The first that fails names the stage: completeness_check
    (tables of several chunks), citation_check (no row has a source), row_selection, numeric_parsing, unit_check, calculation.
    """
    torn = completeness(chunks, key, "index", "count", "start", "end", "rows").where("not complete").select(key, F.lit("completeness_check").alias("_first"))
    uncited = cells.groupBy(key).agg(F.bool_or("cited").alias("_cited")).where("not _cited").select(key, F.lit("citation_check").alias("_second"))
    rows, lost = selected_rows(cells, [key], "label", wanted)
    found = column_statistic(rows, [key], "cell", op, selected=F.col("picked"), table_unit=F.col("unit"))
    every = cells.select(key).distinct().join(torn, key, "left").join(uncited, key, "left").join(lost.withColumn("_third", F.lit("row_selection")), key, "left").join(found, key, "left")
    stage = F.coalesce("_first", "_second", "_third", "failure_stage")
    good = stage.isNull()
    return every.select(
        key, F.when(good, OK).otherwise(BAD).alias("status"), stage.alias("failure_stage"), F.when(good, F.col("value")).alias("value"),
        F.when(good, F.col("unit")).alias("unit"), F.when(good, F.col("input_count")).otherwise(0).alias("input_count"),
    )


def combine_all(op: str, values: Column, units: Column, cited: Column) -> Column:
    """struct(status, failure_stage, value, unit, input_count) of two operands or more: sum or mean of an array.

    In order: fewer than two or a missing operand (structural), no source at all (citation_check), units that differ, null
    agreeing with null alone (unit_check).
    """
    if op not in ("sum", "mean"):
        raise ValueError(f"{op} takes two operands: see combine()")
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    kinds = F.size(F.array_distinct(units))
    stage = F.when((n < 2) | F.exists(values, lambda x: x.isNull()), "structural").when(~cited, "citation_check").when(kinds > 1, "unit_check")
    good = stage.isNull()
    return F.struct(
        F.when(good, OK).otherwise(BAD).alias("status"), stage.alias("failure_stage"), F.when(good, total if op == "sum" else total / n).alias("value"),
        F.when(good, F.get(units, F.lit(0))).alias("unit"), F.when(good, n).otherwise(0).alias("input_count"),
    )
