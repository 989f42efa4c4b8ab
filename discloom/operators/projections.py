"""Projections, payload shapes and predicates of results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from discloom.functions.text import adjacent_distinct, collapse

#: Words of a note that states a limit, and notes that say nothing.
LIMITS = ("확인할 수 없", "제공되지 않", "부족", "한계", "unavailable", "not available")
NOTHING = ("", "-", "없음", "none", "null", "n/a")


def declared(df: DataFrame, properties: Iterable[str]) -> DataFrame:
    """Only the declared columns that there are."""
    own = set(properties)
    return df.select([c for c in df.columns if c in own])


def exact_fields(config: Mapping[str, object], fields: Mapping[str, type]) -> dict[str, object]:
    """A configuration with exactly these fields of these types; bool is no int."""
    if set(config) != set(fields):
        raise ValueError(f"fields missing {sorted(set(fields) - set(config))}, unknown {sorted(set(config) - set(fields))}")
    for k, kind in fields.items():
        if not isinstance(config[k], kind) or (kind is int and isinstance(config[k], bool)):
            raise ValueError(f"{k} must be {kind.__name__}")
    return dict(config)


def as_record(**columns: Column) -> Column:
    return F.struct(F.lit("record").alias("type"), F.struct(*[v.alias(k) for k, v in columns.items()]).alias("fields"))


def unique_names(headers: Column) -> Column:
    """nth repeat of a name as `name [n]`, blank as column_i, within one array."""
    flat = F.transform(headers, lambda h: F.array_join(h, " > "))
    nth = lambda x, i: F.size(F.filter(F.slice(flat, 1, i + 1), lambda y: y == x))
    return F.transform(flat, lambda x, i: F.when(F.trim(x) == "", F.concat(F.lit("column_"), i.cast("string"))).when(nth(x, i) > 1, F.concat(x, F.lit(" ["), nth(x, i).cast("string"), F.lit("]"))).otherwise(x))


def keyed_values(headers: Column, values: Column) -> Column:
    """Positional values by unique header; another width raises."""
    wrong = F.raise_error(F.concat(F.lit("record width "), F.size(values).cast("string"), F.lit(" under "), F.size(headers).cast("string"), F.lit(" headers")))
    return F.when(F.size(headers) != F.size(values), wrong).otherwise(F.map_from_arrays(unique_names(headers), values))


def named_values(json_text: Column, name: str) -> Column:
    """Every string that stands under `name` at any depth of a JSON text, in order, once."""
    return F.array_distinct(F.regexp_extract_all(json_text, F.lit(rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1))


def forbidden_fields(schema: T.StructType, forbidden: Iterable[str], prefix: str = "") -> list[str]:
    """Paths of forbidden names in a nested schema."""
    out = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        if f.name in set(forbidden):
            out.append(path)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += forbidden_fields(kind, forbidden, f"{path}.")
    return out


def checked_context(text: Column, metadata: Mapping[str, Column]) -> Column:
    """The `name: value` lines at a text's head as a struct; a value other than the metadata's raises."""
    out = []
    for name, want in metadata.items():
        found = F.regexp_extract(text, rf"(?m)^{name}: (.*)$", 1)
        out.append(F.when(~found.eqNullSafe(want), F.raise_error(F.concat(F.lit(f"{name} differs: "), found))).otherwise(found).alias(name))
    return F.struct(*out)


def market_cap_text(hundred_millions: Column) -> Column:
    return F.concat(F.format_number(hundred_millions, 0), F.lit("억원"))


def needs_compaction(items: Column, most: int = 10, characters: int = 1000) -> Column:
    return (F.size(items) > most) | (F.length(F.to_json(items)) > characters)


def is_limitation(note: Column) -> Column:
    text = F.lower(collapse(note))
    return F.coalesce(F.exists(F.array(*map(F.lit, LIMITS)), lambda w: F.contains(text, w)), F.lit(False))


def real_note(note: Column) -> Column:
    """Null where a note says nothing."""
    return F.when(~F.lower(collapse(note)).isin(*NOTHING), collapse(note))


def references_or_nothing(df: DataFrame, key: str, disclosure: str, section: str, evidence: str, position: str) -> DataFrame:
    """key and its references in order, once; one invalid reference (no disclosure, or evidence without section) voids all."""
    valid = F.col(disclosure).isNotNull() & (F.col(section).isNotNull() | F.col(evidence).isNull())
    out = df.groupBy(key).agg(F.bool_and(valid).alias("ok"), F.array_sort(F.collect_list(F.struct(position, disclosure, section, evidence))).alias("r"))
    refs = F.array_distinct(F.transform("r", lambda x: F.struct(x[disclosure].alias("disclosure_id"), x[section].alias("section_id"), x[evidence].alias("evidence_id"))))
    return out.select(key, F.when(F.col("ok"), refs).otherwise(F.array().cast("array<struct<disclosure_id:string,section_id:string,evidence_id:string>>")).alias("source_references"))


def kept_sections(sections: DataFrame, doc: str, section: str, parent: str, boundary: str) -> DataFrame:
    """Root sections go where a document has real ones; their children become roots."""
    from pyspark.sql import Window

    real = F.max((F.col(boundary) != "ROOT").cast("int")).over(Window.partitionBy(doc)) == 1
    marked = sections.withColumn("_gone", (F.col(boundary) == "ROOT") & real)
    gone = marked.where("_gone").select(doc, F.col(section).alias(parent), F.lit(True).alias("_lost"))
    left = marked.where("not _gone").join(gone, [doc, parent], "left")
    return left.withColumn(parent, F.when(F.col("_lost"), -1).otherwise(F.col(parent))).select(sections.columns)


def citation(company: Column, report: Column, day: Column, path: Column) -> Column:
    """`company, report (2024-03-05), a > b`."""
    return F.concat(company, F.lit(", "), report, F.lit(" ("), F.date_format(day, "yyyy-MM-dd"), F.lit(")"), F.when(F.size(path) > 0, F.concat(F.lit(", "), F.array_join(path, " > "))).otherwise(""))


def table_metadata(title: Column, **lists: Column) -> Column:
    """A struct of a table's title and lists of texts: blank texts left out, what is empty then null."""
    full = {k: F.filter(v, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))) for k, v in lists.items()}
    return F.struct(F.when(F.trim(title) != "", title).alias("title"), *[F.when(F.size(v) > 0, v).alias(k) for k, v in full.items()])


def grouped_header_lines(headers: Column) -> Column:
    """Header paths as lines: columns under one parent share its line, in order of first sight; repeats go."""
    paths = F.array_distinct(F.filter(F.transform(headers, adjacent_distinct), lambda p: F.size(p) > 0))
    parent = lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(1)))
    alone = lambda p: F.size(p) == 1
    # a line is a lone path, or the first path of its parent
    heads = F.filter(paths, lambda p, i: alone(p) | ~F.exists(F.slice(paths, F.lit(1), i), lambda q: ~alone(q) & (parent(q) == parent(p))))
    leaves = lambda p: F.array_distinct(F.transform(F.filter(paths, lambda q: ~alone(q) & (parent(q) == parent(p))), lambda q: F.element_at(q, -1)))
    told = lambda p: F.when(alone(p), p[0]).when(F.size(leaves(p)) > 1, F.concat(F.array_join(parent(p), " > "), F.lit(" : "), F.array_join(leaves(p), " | "))).otherwise(F.array_join(p, " > "))
    return F.transform(heads, told)


def json_scalar(x: Column, kind: str) -> Column:
    """A value as JSON takes it: decimals and dates as text, bytes as lower-case hex; numbers, texts and truth values as they are."""
    if kind.startswith("decimal") or kind == "date":
        return x.cast("string")
    if kind.startswith("timestamp"):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    return F.lower(F.hex(x)) if kind == "binary" else x


def error_class(names: Column, messages: Column) -> Column:
    """TIMEOUT, INVALID_QUERY or ERROR by a chain of exceptions' names and messages, outermost first: the first that tells decides."""
    links = F.zip_with(F.transform(names, F.lower), F.transform(messages, F.lower), lambda n, m: F.struct(n.alias("n"), m.alias("m")))
    late = lambda x: F.contains(x["n"], F.lit("timeout")) | F.contains(x["m"], F.lit("timed out"))
    wrong = lambda x: x["n"].rlike("syntax|clienterror|validation") | x["m"].rlike("syntax error|invalid query|bad request")
    told = F.filter(F.transform(links, lambda x: F.when(late(x), "TIMEOUT").when(wrong(x), "INVALID_QUERY")), lambda x: x.isNotNull())
    return F.coalesce(F.get(told, F.lit(0)), F.lit("ERROR"))


def first_named(json_text: Column, names: Iterable[str]) -> Column:
    """The first text under any of the names, in the order of the names, at any depth of a JSON text."""
    return F.coalesce(*[F.get(named_values(json_text, n), F.lit(0)) for n in names])


def canonical_table(columns: Sequence[str], records: Column) -> Column:
    """A table as compact JSON of its column names and its rows of texts, in order; null cells kept."""
    return F.to_json(F.struct(F.array(*map(F.lit, columns)).alias("columns"), records.alias("records")), {"ignoreNullFields": "false"})
