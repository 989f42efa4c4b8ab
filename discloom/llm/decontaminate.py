"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, offsets mapped to the original.

Words are runs of letters and digits (any non-ASCII character counts as one), A-Z lower-cased. A window is ten
consecutive words of an item; an item of fewer words, but not none, is one window. Each text is normalised to
its words between single spaces and scanned once; a match of a window, spaces included, is a match of its words.

The automaton travels to executors as the items. Its size is bounded: items are dealt by hash to shards of about
AUTOMATON_BYTES of ids and texts, of which a benchmark suite fills one. Each shard has an automaton of its own and scans
every whole text once; hits of several shards, a row for each document that has any, are merged by row. The driver
holds one shard at a time.

Edge cases: null texts and texts without words have n_words 0 and no hits; items without words are ignored;
items of one text both count; null item_ids count as items but are not named. Empty tables give no rows or no hits.
Repeated rows each get a row. Very long texts are scanned whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from discloom.llm.common import bounded_batches, materialise

WINDOW = 10
#: Bytes of item ids and texts that one automaton holds (about 20 times as much memory in each Python worker).
AUTOMATON_BYTES = 4 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
#: Words of a text whose A-Z still stand.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"

_built: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def item_windows(words: list[bytes], width: int = WINDOW) -> list[list[bytes]]:
    return [words[k : k + width] for k in range(max(1, len(words) - width + 1))] if words else []


def _automaton(key: str, items: list[tuple[str | None, list[bytes]]]) -> ahocorasick.Automaton:
    """Kept for the life of the worker: tasks of one query share it."""
    if key not in _built:
        _built.clear()
        owners: dict[bytes, tuple[int, list[int]]] = {}
        for n, (_, words) in enumerate(items):
            for window in item_windows(words):
                owners.setdefault(b" " + b" ".join(window) + b" ", (len(window), []))[1].append(n)
        made = ahocorasick.Automaton()
        for pattern, (size, found) in owners.items():
            made.add_word(pattern.decode("latin-1"), (len(pattern), size, tuple(sorted(set(found)))))
        if owners:
            made.make_automaton()
        _built[key] = made
    return _built[key]


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character ranges in the original of each run of hit words."""
    spans: list[dict[str, int]] = []
    last = -2
    for n, m in enumerate(_WORD.finditer(text)):
        if hit[n]:
            if n == last + 1:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = n
    return spans


def _hits(batches: Iterator[pa.RecordBatch], key: str, items: list[tuple[str | None, list[bytes]]]) -> Iterator[tuple]:
    """(batch, row of it, text, number of words, runs hit as (first word, words), items that occur) of every row."""
    machine = _automaton(key, items)
    ready = len(machine) > 0
    for batch in batches:
        for row, text in enumerate(batch.column(1)):
            text = text.as_py()
            words = normal_words(text)
            runs: dict[tuple[int, int], None] = {}
            owners: set[int] = set()
            if words and ready:
                line = b" " + b" ".join(words) + b" "
                found = list(machine.iter(line.decode("latin-1")))
                if found:
                    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                    firsts = np.searchsorted(gaps, np.array([end - length + 1 for end, (length, _, _) in found]))
                    for first, (_, (_, size, own)) in zip(firsts.tolist(), found, strict=True):
                        runs[first, size] = None
                        owners.update(own)
            yield batch, row, text, len(words), list(runs), owners


def _result(ids: pa.Array, rows: list[tuple[str | None, int, list[tuple[int, int]], int, list[str]]]) -> pa.RecordBatch:
    """RESULT's rows from (text, number of words, runs, number of items, names) of each."""
    n_hit, spans = [], []
    for text, n, runs, _, _ in rows:
        hit = np.zeros(n, bool)
        for first, size in runs:
            hit[first : first + size] = True
        n_hit.append(int(hit.sum()))
        spans.append(_spans(text or "", hit) if runs else [])
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array([r[1] for r in rows], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(r[4])).encode()).hexdigest() for r in rows], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
    )


def _named(items: list[tuple[str | None, list[bytes]]], owners: set[int]) -> list[str]:
    return [str(items[k][0]) for k in owners if items[k][0] is not None]


def _scanner(key: str, items: list[tuple[str | None, list[bytes]]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(text, n, runs, len(owners), _named(items, owners)) for _, _, text, n, runs, owners in _hits(iter([batch]), key, items)]
            yield _result(batch.column(0), rows)

    return scan


SHARD_HITS = "row long, firsts array<int>, sizes array<int>, n_items long, names array<string>"


def _shard_scanner(key: str, items: list[tuple[str | None, list[bytes]]]):
    """SHARD_HITS of the rows (row, text) that hold a window of this shard."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row, runs, len(owners), _named(items, owners)) for _, row, _, _, runs, owners in _hits(iter([batch]), key, items) if runs]
            if rows:
                numbers = batch.column(0).take(pa.array([r[0] for r in rows]))
                firsts, sizes = ([[run[k] for run in r[1]] for r in rows] for k in (0, 1))
                columns = [numbers, pa.array(firsts, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "firsts", "sizes", "n_items", "names"])

    return scan


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, firsts, sizes, n_items, names in zip(*(batch.column(c).to_pylist() for c in ("text", "firsts", "sizes", "n_items", "names")), strict=True):
            rows.append((text, len(normal_words(text)), list(zip(firsts or [], sizes or [], strict=True)), n_items, names or []))
        yield _result(batch.column("doc_id"), rows)


def _shards(items: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[tuple[int, str, list[tuple[str | None, list[bytes]]]]]:
    """(number of shards, key, ids and words of the items in order) of each shard, one at a time; there is always one."""
    asked = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.col("text").rlike(_WORD.pattern))
    size = asked.agg(F.sum(F.octet_length("text").cast("long") + F.coalesce(F.octet_length("item_id"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else asked
        pairs = sorted(((r.item_id, normal_words(r.text)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        yield n, hashlib.sha256(repr(pairs).encode()).hexdigest(), pairs


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """RESULT's columns for every row of docs; spans are character offsets into the original text."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, hits = None, []
    for n, key, pairs in _shards(items, item_id, item_text, limit):
        if n == 1:
            return texts.mapInArrow(_scanner(key, pairs), RESULT)
        rows = materialise(texts.withColumn("row", F.monotonically_increasing_id()), "texts") if rows is None else rows
        hits.append(materialise(rows.select("row", "text").mapInArrow(_shard_scanner(key, pairs), SHARD_HITS), "hits"))
    # items are dealt to one shard each, so counts add up
    met = reduce(DataFrame.unionAll, hits).groupBy("row").agg(
        F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("sizes")).alias("sizes"), F.sum("n_items").alias("n_items"), F.flatten(F.collect_list("names")).alias("names")
    )
    found = rows.join(met, "row", "left").select("doc_id", "text", "firsts", "sizes", F.coalesce("n_items", F.lit(0)).alias("n_items"), "names")
    return found.mapInArrow(_merged, RESULT)


def _cleaner(key: str, items: list[tuple[str | None, list[bytes]]], at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["row", "text"])
            yield batch.filter(pa.array([not runs for *_, runs, _ in _hits(iter([pair]), key, items)], pa.bool_()))

    return clean


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of docs without a hit, with their own columns; rows are judged in place, without a join, by one shard after another."""
    bounded_batches(docs.sparkSession)
    at, left = docs.columns.index(text_col), docs
    for n, key, pairs in _shards(items, "item_id", "text", limit):
        left = left.mapInArrow(_cleaner(key, pairs, at), docs.schema)
        left = materialise(left, "clean") if n > 1 else left
    return left


ORACLE = r"""
with docs as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null
), item_windows as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from items where len(w) > 0)
), sizes as (
  select distinct size from item_windows
), doc_windows as (
  select row, k, size, array_to_string(w[k : k + size - 1], ' ') as win
  from (select row, w, size, unnest(range(1, len(w) - size + 2)) as k from docs, sizes where len(w) >= size)
), hits as (
  select d.row, d.k, d.size, i.item_id from doc_windows d join item_windows i on d.size = i.size and d.win = i.win
), words as (
  select row, count(distinct word) as n_hit from (select row, unnest(range(k, k + size)) as word from hits) group by row
), owners as (
  select row, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct row, item_id from hits) group by row
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(o.n_items, 0)::bigint as n_items,
  sha256(coalesce(o.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join words h using (row) left join owners o using (row)
"""
