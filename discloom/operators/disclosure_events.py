"""Events of disclosures: facts and texts of their evidence, dated and ordered by the tables of their family.

The tables are small and fixed, so they stand in the expressions: nothing is joined or broadcast for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from discloom.functions.text import collapse, compact_key, find_date
from discloom.operators import event_tables as T

#: Records of a table that are looked at for marks of a correction.
LOOKED_AT = 8


def _texts(x: Column) -> Column:
    """Texts with something in them, collapsed, each once."""
    return F.array_distinct(F.filter(F.transform(x, collapse), lambda v: F.coalesce(v != "", F.lit(False))))


def _compact(word: str) -> str:
    """compact_key() of a fixed word."""
    return re.sub("[^0-9A-Za-z가-힣%]", "", word).lower()


def _bound(x: Column, make: Callable[[Column], Column]) -> Column:
    """make() of x, which is computed once however often it is named."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def _holds(x: Column, words: tuple[str, ...]) -> Column:
    """Is one of the words in x? One search, so that x is computed once."""
    return x.rlike("|".join(map(_compact, words)))


def _tells(x: Column, words: tuple[str, ...]) -> Column:
    """_holds() of compact_key(x) for words without case, x left as it is: anything that compact_key() drops may stand between letters."""
    return x.rlike("|".join("[^0-9A-Za-z가-힣%]*".join(_compact(w)) for w in words))


def _looked_up(table: Mapping[str, object], x: Column, make: Callable[[object], Column]) -> Column:
    """make(table[x]) from a map that folds to a literal, null for other keys."""
    return F.try_element_at(F.create_map(*[c for key, value in table.items() for c in (F.lit(key), make(value))]), x)


def family(event_type: Column, subtype: Column) -> Column:
    """The family whose tables read an event: by subtype, else by type."""
    return F.coalesce(_looked_up(T.FAMILY_OF_SUBTYPE, subtype, F.lit), _looked_up(T.FAMILY_OF_TYPE, event_type, F.lit), F.lit("generic"))


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(_compact(w)) for w in words]) if words else F.array().cast("array<string>")


def _rank(words: Column, key: Column) -> Column:
    """The place of the first word that the key holds."""
    return F.array_min(F.transform(words, lambda w, i: F.when(F.contains(key, w), i)))


def chosen_evidence(evidence: DataFrame, known: DataFrame) -> DataFrame:
    """evidence of the known documents with their columns; of group major only the first section that has any."""
    met = evidence.join(known, "doc")
    met = met.withColumn("_first", F.min("section").over(Window.partitionBy("doc")))
    return met.where((F.col("doc_group") != "major") | (F.col("section") == F.col("_first"))).drop("_first")


#: What an item of evidence is; a SPARE one says that its table has facts, used or not.
FACT, TEXT, SPARE = 0, 1, 2
#: Behind all words of a family.
LAST = 1 << 30


def items(chosen: DataFrame) -> DataFrame:
    """doc, event_type, subtype, section, ordinal, evidence, path, kind, part, pos, key, compact, value: facts and texts of evidence, in one pass over it.

    Facts are fields by their first key path; an exchange table's header row; records as key of all but the last distinct value.
    Tables that tell of a correction give none.
    """
    shown = F.to_json(F.struct("title", "units", "captions", "notes", "headers", "fields", F.transform(F.slice("records", 1, LOOKED_AT), lambda r: r["values"]).alias("rows")))
    name = F.concat_ws(":", F.col("section").cast("string"), F.col("ordinal").cast("string"))
    full = lambda x: F.array_join(F.filter(F.transform(x, collapse), lambda v: v != ""), " > ")
    keyed = lambda x: F.when(F.size(x) > 1, F.struct(F.array_join(F.slice(x, F.lit(1), F.size(x) - 1), " > ").alias("key"), F.element_at(x, -1).alias("value")))
    pair = lambda values: _bound(_texts(values), keyed)
    of_field = lambda f: F.struct(full(F.get(f["key_paths"], F.lit(0))).alias("key"), collapse(f["raw_value"]).alias("value"))
    parts = [
        F.transform("fields", of_field), F.when(F.col("doc_group") == "exchange", F.array(pair(F.transform("headers", full)))),
        F.transform("records", lambda r: pair(F.concat(r["row_context"], r["values"]))),
    ]

    def item(kind: int, part: Column, pos: Column, key: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), part.alias("part"), pos.alias("pos"), key.alias("key"), compact_key(key).alias("compact"), value.alias("value"))

    def placed(part: int) -> Column:
        own = F.transform(parts[part], lambda f, i: item(FACT, F.lit(part), i, f["key"], f["value"]))
        return F.coalesce(own, F.array().cast("array<struct<kind:int,part:int,pos:int,key:string,compact:string,value:string>>"))

    single = lambda kind, value: F.array(item(kind, F.lit(0), F.lit(0), F.lit(""), value))
    found = F.filter(F.concat(*map(placed, range(len(parts)))), lambda x: (x["key"] != "") & (x["value"] != ""))
    facts = _bound(found, lambda x: F.when(F.size(x) > 0, F.concat(x, single(SPARE, name))))
    every = F.when(F.col("kind") == "TEXT", single(TEXT, collapse(F.col("text")))).when((F.col("kind") == "TABLE") & ~_tells(shown, T.CORRECTIONS), facts)
    path = F.when(F.col("kind") == "TEXT", _texts(F.col("heading_path")))
    return chosen.select("doc", "event_type", "subtype", "section", "ordinal", name.alias("evidence"), path.alias("path"), F.inline(every)).where("value <> ''")


def supports(found: DataFrame) -> DataFrame:
    """doc, day, lines, used, told, heard, spare of the items of each document.

    day: of the first date key of the subtype that a fact's key holds and whose value is a date. lines, used: facts by the family's
    keywords, then in order; alike facts once; nothings, formalities and corrections left out. told, heard: texts in order, alike ones
    once, each after its heading path. spare: the evidence of all facts in order, which supports an event that uses none of them.
    """
    fact, key = F.col("kind") == FACT, F.col("compact")
    dates = F.coalesce(_looked_up(T.DATES, F.col("subtype"), _words), _words(T.GENERIC_DATES))
    words = _looked_up(T.KEYWORDS, family(F.col("event_type"), F.col("subtype")), _words)
    ranked = found.withColumns({
        # a fact may hold several keys: the first counts, and later ones can't come before it
        "_date": F.when(fact, _rank(dates, key)),
        "_rank": F.when(fact, F.coalesce(_rank(words, key), F.lit(LAST))).otherwise(0),
        "_plain": ~fact | ~(F.col("value").isin(*T.NOTHING) | _holds(key, T.FORMALITIES + T.CORRECTIONS)),
    })
    at = ["section", "ordinal", "part", "pos"]
    dated = F.when(F.col("_date").isNotNull(), _bound(find_date(F.col("value")), lambda day: F.when(day.isNotNull(), F.struct(F.col("_date").alias("rank"), *at, day.alias("day")))))
    kept = F.when(F.col("_plain"), F.struct(F.col("_rank").alias("rank"), *at, "key", "value", "path", "evidence"))
    once = ranked.groupBy("doc", "kind", "compact", "value").agg(F.min(kept).alias("x"), F.min(dated).alias("d"))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("x"))))
    out = once.groupBy("doc").agg(F.min("d").alias("d"), listed(FACT).alias("fs"), listed(TEXT).alias("ts"), listed(SPARE).alias("ss"))
    some = lambda x, make: F.when(F.size(x) > 0, F.transform(x, make))
    line = lambda t: F.concat(F.lit("- "), F.when(F.size(t["path"]) > 0, F.concat(F.array_join(t["path"], " > "), F.lit(": "))).otherwise(""), t["value"])
    evidence = lambda x: x["evidence"]
    return out.select(
        "doc", F.col("d.day").alias("day"), some("fs", lambda f: F.concat(F.lit("- "), f["key"], F.lit(": "), f["value"])).alias("lines"), some("fs", evidence).alias("used"),
        some("ts", line).alias("told"), some("ts", evidence).alias("heard"), some("ss", evidence).alias("spare"),
    )


def build_events(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, event_type, subtype, family, event_date, issue, content, evidence, status: one event for each latest document of major or exchange.

    documents: doc, doc_group, is_latest, event_type, subtype, receipt_date, company. status is ERROR where nothing supports the event.
    """
    known = documents.where("is_latest and doc_group in ('major', 'exchange')")
    of_evidence = known.select("doc", "doc_group", "event_type", "subtype")
    out = known.join(supports(items(chosen_evidence(evidence, of_evidence))), "doc", "left")
    receipt = F.col("receipt_date").cast("string")
    out = out.withColumns({
        "event_date": F.coalesce("day", F.try_to_date(receipt, "yyyyMMdd"), receipt.try_cast("date")),
        "issue": F.when(F.col("day").isNull(), "EVENT_DATE_FALLBACK_TO_RECEIPT_DATE"),
    })
    none = F.array().cast("array<string>")
    used = F.array_distinct(F.concat(F.coalesce("used", none), F.coalesce("heard", none)))
    out = out.withColumn("evidence", F.when(F.size(used) > 0, used).otherwise(F.coalesce("spare", none)))
    part = lambda title, x: F.when(F.size(x) > 0, F.concat(F.lit(title + "\n"), F.array_join(x, "\n")))
    empty = F.when(F.col("lines").isNull() & F.col("told").isNull(), "공시 본문에서 구조화된 핵심 사실을 추출하지 못했습니다.")
    head = F.concat(F.coalesce("company", F.lit("발행회사")), F.lit("의 "), "subtype", F.lit(" 공시 사건"))
    content = F.concat_ws("\n\n", head, F.concat(F.lit("이벤트 분류: "), "event_type"), part("핵심 사실", F.col("lines")), part("보충 설명", F.col("told")), empty)
    status = F.when(F.size("evidence") > 0, "SUCCESS").otherwise("ERROR")
    return out.select("doc", "event_type", "subtype", family(F.col("event_type"), F.col("subtype")).alias("family"), "event_date", "issue", content.alias("content"), "evidence", status.alias("status"))
