"""Readers of manifests, masters and source files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from discloom.functions.numeric import parse_market_cap, strip
from discloom.operators.relational import last_wins

COMPANY_FIELDS = ("corp_code", "stock_code", "corp_name", "corp_eng_name", "market", "industry", "sector", "listing_date", "market_cap")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False, missing_ok: bool = False) -> DataFrame:
    """A row for each JSON object. Lenient: lines that are none are left out. Strict: they fail the read.

    missing_ok: a path that doesn't exist gives no rows.
    """
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows_of_lines(spark.read.text(path), schema)


def rows_of_lines(lines: DataFrame, schema: T.StructType, *beside: str) -> DataFrame:
    """The JSON objects of text lines (column value) as rows, with the columns `beside` of their lines; other lines are left out."""
    lines = lines.where(F.trim("value").startswith("{"))
    row = F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(*beside, row.alias("r")).where("r is not null and r._bad is null").select("r.*", *beside).drop("_bad")


def read_keyed_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The last row of each key; rows without one are left out. Lines stand in the order of file, split and place in the split."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    place = ["_file", "_split", "_line"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line"))
    return last_wins(rows_of_lines(lines, schema, *place).where(F.col(key).isNotNull()), [key], place).drop(*place)


def read_companies(spark: SparkSession, path: str, expected: int | None = 70, sep: str = ",") -> DataFrame:
    """The company master: every field required in the header, blank as null, caps as whole numbers.

    Raises when the row count isn't the expected one, or a code is missing or repeated.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    if lost := [c for c in COMPANY_FIELDS if c not in raw.columns]:
        raise ValueError(f"columns missing: {lost}")
    rows = raw.select(*[F.nullif(strip(F.col(c)), F.lit("")).alias(c) for c in COMPANY_FIELDS])
    n, keyed, distinct = rows.agg(F.count("*"), F.count("corp_code"), F.countDistinct("corp_code")).first()
    if keyed < n or distinct < n or (expected is not None and n != expected):
        raise ValueError(f"{n} rows with {keyed} codes, {distinct} of them distinct; {expected} expected")
    return rows.withColumns({"listing_date": F.col("listing_date").try_cast("date"), "market_cap": parse_market_cap(F.col("market_cap"))})


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def universe_tsv(universe: DataFrame, columns: list[str]) -> str:
    """The bounded universe as tab-separated text for a prompt."""
    rows = universe.select(*columns).collect()
    return "\n".join(["\t".join(columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows)])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, column letter -> text) of every row of a workbook, by the zip and XML modules alone."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
            target = targets[sheet.get(_REL)].lstrip("/")
            path = target if target in names else f"xl/{target}"
            for row in ElementTree.fromstring(book.read(path)).findall("m:sheetData/m:row", _NS):
                cells = {}
                for c in row.findall("m:c", _NS):
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    else:
                        text = c.findtext("m:v", "", _NS)
                        text = shared[int(text)] if c.get("t") == "s" and text else text
                    cells["".join(ch for ch in c.get("r", "") if ch.isalpha())] = text.strip()
                yield sheet.get("name", ""), int(row.get("r", "0")), cells


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """sheet, row, cells (map of column letters) of every row of the workbooks at path."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, s, n, c) for s, n, c in sheet_rows(bytes(data))]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, sheet string, row int, cells map<string,string>")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """row, name, category: columns A and B of the first sheet below its header."""
    rows = read_workbook(spark, path)
    first = rows.agg(F.min_by("sheet", "row")).first()[0]
    return rows.where((F.col("sheet") == first) & (F.col("row") > 1)).select("row", F.col("cells")["A"].alias("name"), F.col("cells")["B"].alias("category")).where("name <> ''")


def read_knowledge(spark: SparkSession, path: str, columns: list[str], lists: list[str]) -> DataFrame:
    """Items of all sheets by header name; `lists` are split at bars, trimmed and freed of repeats; repeated items go."""
    rows = read_workbook(spark, path)
    heads = rows.where("row = 1").select("path", "sheet", F.explode("cells").alias("letter", "field"))
    cells = rows.where("row > 1").select("path", "sheet", "row", F.explode("cells").alias("letter", "value")).join(heads, ["path", "sheet", "letter"])
    wide = cells.groupBy("path", "sheet", "row").pivot("field", columns).agg(F.first("value"))
    split = lambda c: F.array_distinct(F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    return wide.select("sheet", *[split(F.col(c)).alias(c) if c in lists else F.nullif(F.col(c), F.lit("")).alias(c) for c in columns]).dropDuplicates()


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, receipt, content, position of markup files below folders named by receipt: the file of that name first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name, receipt = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    found = files.select("path", name.alias("name"), receipt.alias("receipt"), "content").where(F.lower("name").rlike(r"\.(xml|html|htm)$"))
    from pyspark.sql import Window

    main = F.regexp_replace("name", r"\.[^.]*$", "") != F.col("receipt")
    return found.withColumn("position", F.row_number().over(Window.partitionBy("receipt").orderBy(main, F.lower("name"))) - 1)


def reusable(previous: DataFrame, current: DataFrame, key: list[str], digest: str, version: str) -> DataFrame:
    """Rows of current that must be built anew: none of previous has their key, digest and version."""
    return current.join(previous.select(*key, digest, version), [*key, digest, version], "left_anti")
