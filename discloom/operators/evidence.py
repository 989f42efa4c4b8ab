"""Evidence of documents: texts and tables of each section in order, with heading paths, captions, units and notes."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame

from discloom.operators.documents import _spread, grid, headers_of, kv_fields, load, records, sections, table_type

#: Fixed patterns: what a short text beside a table is.
UNIT = re.compile(r"^[(\[]?\s*단위\s*[:：]")
NOTE = re.compile(r"^([(]?주\s*\d*[)]|※|\*+|주석)")
CAPTION = re.compile(r"^[<〈\[【].*[>〉\]】]$")
PERIOD = re.compile(r"(당기|전기|\d{4}년|기준일)")
NOTICE = re.compile(r"참조|참고하시기")
NAVIGATION = re.compile(r"^(목\s*차|표지|페이지|\d+\s*/\s*\d+)$")

EVIDENCE = (
    "doc long, section int, ordinal int, kind string, table_type string, role string, text string, heading_path array<string>, title string, units array<string>, captions array<string>, notes array<string>, "
    "headers array<array<string>>, fields array<struct<key_paths:array<array<string>>,raw_value:string>>, records array<struct<record_index:int,row_type:string,row_context:array<string>,values:array<string>>>"
)


def role_of(text: str) -> str:
    if UNIT.match(text):
        return "UNIT"
    if NOTE.match(text):
        return "NOTE"
    if CAPTION.match(text):
        return "CAPTION"
    return "REFERENCE_NOTICE" if len(text) <= 80 and NOTICE.search(text) else "BODY"


def table_context(blocks: list[dict]) -> tuple[dict[int, dict[str, list[str]]], set[int]]:
    """For each table block: title, units, captions and notes of its neighbours; and the blocks that were used up.

    Backward over adjacent short texts until a body text or a block in use; forward over notes only. A unit and a
    caption that names no period carry over to the next table if nothing lies between and it has no caption.
    """
    context: dict[int, dict[str, list[str]]] = {}
    used: set[int] = set()
    last: tuple[int, dict[str, list[str]]] | None = None
    for k, b in enumerate(blocks):
        if b["type"] != "TABLE":
            continue
        own: dict[str, list[str]] = {"units": [], "captions": [], "notes": []}
        j = k - 1
        while j >= 0 and j not in used and blocks[j]["type"] in ("P", "SPAN_RUN"):
            text = blocks[j]["text"]
            role = role_of(text) if text else "BLANK"
            if role in ("BODY", "REFERENCE_NOTICE"):
                break
            if role != "BLANK":
                own[{"UNIT": "units", "CAPTION": "captions", "NOTE": "notes"}[role]].insert(0, text)
            used.add(j)
            j -= 1
        if last and not own["captions"] and j == last[0]:
            own["units"] = own["units"] or last[1]["units"]
            own["captions"] = [c for c in last[1]["captions"] if not PERIOD.search(c)]
        j = k + 1
        while j < len(blocks) and blocks[j]["type"] in ("P", "SPAN_RUN") and (not blocks[j]["text"] or role_of(blocks[j]["text"]) == "NOTE"):
            if blocks[j]["text"]:
                own["notes"].append(blocks[j]["text"])
            used.add(j)
            j += 1
        context[k] = own
        last = (j - 1 if own["notes"] else k, own)
    return context, used


def layout_only(rows: list[list[str]]) -> bool:
    """A cover, navigation or spacing table: hardly any text, or nothing but navigation words."""
    texts = [t for row in rows for t in row if t]
    return not texts or all(NAVIGATION.match(t) for t in texts) or (len(texts) == 1 and len(texts[0]) <= 2)


def evidence_of(source: str | None, strict: bool) -> list[tuple]:
    root, *_ = load(source, strict)
    out = []
    for s in sections(root) if root is not None else []:
        context, used = table_context(s["blocks"])
        seen: set[str] = set()
        ordinal, before = 0, None
        for k, b in enumerate(s["blocks"]):
            if b["type"] == "TABLE":
                before = None
                g, _, tops = grid(b["node"])
                kind, tops = table_type(g, tops)
                texts = [[c.text if c else "" for c in row] for row in g]
                if kind == "LAYOUT" or (kind == "UNKNOWN" and layout_only(texts)):
                    if (text := b["text"]) and not layout_only(texts) and k not in used:
                        out.append((s["order"], ordinal, "TEXT", None, "BODY", text, s["path"], None, [], [], [], [], [], []))
                        ordinal += 1
                    continue
                # a table of no known kind is kept as records if it is wide, else as a text
                fields = kv_fields(g) if kind == "KV_TABLE" else []
                rows = records(g, tops) if kind == "R_TABLE" or (kind == "UNKNOWN" and len(g) > 1 and len(g[0]) > 1) else []
                if not fields and not rows:
                    out.append((s["order"], ordinal, "TEXT", None, "BODY", b["text"], s["path"], None, [], [], [], [], [], []))
                    ordinal += 1
                    continue
                heads = headers_of(g, tops) if rows else []
                digest = hashlib.sha256(json.dumps([heads, fields, rows], ensure_ascii=False, sort_keys=True).encode()).hexdigest()
                if digest in seen:
                    continue
                seen.add(digest)
                own = context[k]
                out.append((s["order"], ordinal, "TABLE", "R_TABLE" if rows else "KV_TABLE", None, None, s["path"], (own["captions"] or [s["title"]])[0] or None, own["units"], own["captions"], own["notes"], heads, fields, rows))
                ordinal += 1
            elif b["type"] in ("P", "SPAN_RUN") and k not in used and b["text"]:
                if b["text"].casefold() == before:
                    continue
                before = b["text"].casefold()
                out.append((s["order"], ordinal, "TEXT", None, role_of(b["text"]), b["text"], s["path"], None, [], [], [], [], [], []))
                ordinal += 1
    return out


def evidence_rows(docs: DataFrame, id_col: str, markup: str, strict: bool = False) -> DataFrame:
    """EVIDENCE's columns: each section's texts and tables in order. Tables of one content count once in a section."""
    return _spread(docs, id_col, markup, lambda key, source: [(key, *row) for row in evidence_of(source, strict)], EVIDENCE)
