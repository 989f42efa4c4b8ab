"""Text normalisation, dates, ids and rendering, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from discloom.functions.numeric import strip

_SPACE = r"[\s 　]+"
#: Document families told by a literal in the name, the first that it holds.
FAMILIES = ("주식등의대량보유상황보고서", "대량보유상황보고서", "주요사항보고서", "사업보고서", "반기보고서", "분기보고서", "단일판매공급계약체결")
#: Fixed patterns of repairs: controls that XML forbids, ampersands and angle brackets that open nothing, tags that are prose.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
BARE_AMPERSAND = r"&(?!#\d+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]+;)"
BARE_BRACKET = r"<(?=[^A-Za-z/!?])"
PROSE_TAG = r"<([A-Za-z][^<>=]*\s[^<>=]*)>"


def collapse(x: Column) -> Column:
    """Runs of whitespace become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, _SPACE, " "))


def compact_key(x: Column) -> Column:
    """Letters, digits, Hangul syllables and % alone, lower-cased."""
    return F.lower(F.regexp_replace(x, "[^0-9A-Za-z가-힣%]+", ""))


def squeeze(x: Column) -> Column:
    """No whitespace at all, for comparing texts that differ in layout only."""
    return F.regexp_replace(x, _SPACE, "")


def normal_text(x: Column) -> Column:
    """Collapsed, without blanks before punctuation."""
    return F.regexp_replace(collapse(x), r" ([,.;:!?%)\]])", "$1")


def clean_report_name(x: Column) -> Column:
    """Without a leading [...정정...] and with 주요사항보고서(...) unwrapped."""
    plain = strip(F.regexp_replace(x, r"\[[^\]]*정정[^\]]*\]", ""))
    inner = F.regexp_extract(plain, r"^주요사항보고서\s*\((.*)\)$", 1)
    return F.when(inner != "", strip(inner)).otherwise(plain)


def document_name_key(x: Column) -> Column:
    """The name without a leading [...정정...], its letters, digits and Hangul alone, lower-cased; null where none is left."""
    plain = F.regexp_replace(x, r"^\s*\[[^\]]*정정[^\]]*\]\s*", "")
    return F.nullif(F.lower(F.regexp_replace(plain, "[^0-9A-Za-z가-힣]", "")), F.lit(""))


def document_family(x: Column) -> Column:
    """The first family literal that the name's key holds, else the key itself."""
    key = document_name_key(x)
    return F.coalesce(*[F.when(F.contains(key, F.lit(f)), F.lit(f)) for f in FAMILIES], key)


#: Fixed patterns: a day written with marks between its parts, and one of eight digits.
MARKED_DATE = r"(20\d{2})\s*(?:년|[-./])\s*(\d{1,2})\s*(?:월|[-./])\s*(\d{1,2})\s*일?"
COMPACT_DATE = r"(?<!\d)(20\d{6})(?!\d)"


def find_date(x: Column) -> Column:
    """The first day in the text (2024년 3월 5일, 2024-03-05, 2024.3.5; else 20240305); null where there is none or no such day exists."""
    parts = [F.regexp_extract(x, MARKED_DATE, k) for k in (1, 2, 3)]
    marked = F.concat(parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.try_to_date(F.when(parts[0] != "", marked).otherwise(F.nullif(F.regexp_extract(x, COMPACT_DATE, 1), F.lit(""))), "yyyyMMdd")


def strict_date(x: Column) -> Column:
    """yyyyMMdd; anything else raises under ANSI mode."""
    return F.to_date(x, "yyyyMMdd")


def iso_date(x: Column) -> Column:
    """yyyyMMdd as yyyy-MM-dd; null where it is none."""
    return F.date_format(F.try_to_date(x, "yyyyMMdd"), "yyyy-MM-dd")


def shift_month(day: Column, months: int) -> Column:
    """The same day of another month, or its last day."""
    return F.add_months(day, months)


def period_bounds(x: Column) -> Column:
    """struct(first, last) of a period: 2024, 2024-03, 2024-03-05, or two of these with ~ between."""
    start, stop = F.trim(F.split_part(x, F.lit("~"), F.lit(1))), F.trim(F.element_at(F.split(x, "~"), -1))
    first = F.when(F.length(start) == 4, F.concat(start, F.lit("-01-01"))).when(F.length(start) == 7, F.concat(start, F.lit("-01"))).otherwise(start).try_cast("date")
    last = F.when(F.length(stop) == 4, F.concat(stop, F.lit("-12-31")).try_cast("date")).when(F.length(stop) == 7, F.last_day(F.concat(stop, F.lit("-01")).try_cast("date"))).otherwise(stop.try_cast("date"))
    return F.struct(first.alias("first"), last.alias("last"))


def granular_bounds(granularity: Column, value: Column) -> Column:
    """struct(first, last) of a normalised period: YEAR, MONTH, DATE, or RANGE of two dates in order; null where it is none."""
    text = F.trim(value)
    day = lambda x: x.try_cast("date")
    found = F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}"), 0)
    first, last = day(F.get(found, F.lit(0))), day(F.get(found, F.lit(1)))
    year = (granularity == "YEAR") & text.rlike(r"^\d{4}$")
    month = (granularity == "MONTH") & text.rlike(r"^\d{4}-\d{2}$")
    date = (granularity == "DATE") & text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    pair = (granularity == "RANGE") & (F.size(found) == 2) & (first <= last)
    low = F.when(year, day(F.concat(text, F.lit("-01-01")))).when(month, day(F.concat(text, F.lit("-01")))).when(date, day(text)).when(pair, first)
    high = F.when(year, day(F.concat(text, F.lit("-12-31")))).when(month, F.last_day(day(F.concat(text, F.lit("-01"))))).when(date, day(text)).when(pair, last)
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("first"), high.alias("last")))


def company_key(corp_code: Column, filer: Column, group: Column) -> Column:
    """The company's code; for holding reports with the filer's name, without punctuation."""
    name = F.lower(F.regexp_replace(filer, r"(?U)\W+", ""))
    return F.when(group == "holding", F.concat_ws("|", corp_code, name)).otherwise(corp_code)


def disclosure_id(x: Column) -> Column:
    """Graph form of a source-side id: section:R:src..., evidence:R:src... become dR:src...."""
    return F.regexp_replace(x, r"^(?:section|evidence|rtable):(\d{14})", "d$1")


def parent_id(x: Column, level: int) -> Column:
    """The first `level` colon-separated parts: 1 disclosure, 3 section, 4 evidence."""
    return F.array_join(F.slice(F.split(x, ":"), 1, level), ":")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of a name, in the JVM: SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        F.substr(variant, nibble % 4 + 1, F.lit(1)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def short_signature(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, order kept."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), F.lit(16))


def json_size(x: Column) -> Column:
    """UTF-8 bytes of the compact JSON of a struct or array, nulls kept."""
    return F.octet_length(F.to_json(x, {"ignoreNullFields": "false"}))


def row_type(labels: Column) -> Column:
    """SUBTOTAL, TOTAL or DATA by a row's label cells."""
    return F.when(F.exists(labels, lambda x: squeeze(x).rlike("소계")), "SUBTOTAL").when(F.exists(labels, lambda x: squeeze(x).rlike("총계|합계")), "TOTAL").otherwise("DATA")


def adjacent_distinct(items: Column) -> Column:
    """Trimmed, without empty parts and without parts that repeat the one before."""
    full = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.filter(full, lambda x, i: (i == 0) | (x != F.element_at(full, F.greatest(i, F.lit(1)))))


def path_text(items: Column) -> Column:
    return F.array_join(adjacent_distinct(items), " > ")


def context_text(parts: list[tuple[str, Column]]) -> Column:
    """Lines of `name: value`, a blank line between; absent values leave no line."""
    return F.concat_ws("\n\n", *[F.when(F.nullif(strip(v), F.lit("")).isNotNull(), F.concat(F.lit(f"{n}: "), strip(v))) for n, v in parts])


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


#: Fixed patterns: headings, list markers, units, notes and captions of disclosure texts.
CLASSES = {
    "HEADING": r"^(제\s*\d+\s*[장절조]|[IVX]+\.|\d+(\.\d+)*\.|[가-하]\.|[(]\d+[)]|[①-⑳])\s*\S",
    "UNIT": r"^[(\[]?\s*단위\s*[:：]",
    "NOTE": r"^([(]?주\s*\d*[)]|※|\*+|주석)",
    "CAPTION": r"^([<〈\[【].*[>〉\]】])$",
    "REFERENCE_NOTICE": r"참조|참고하시기",
}


def text_class(x: Column) -> Column:
    """UNIT, NOTE, CAPTION, HEADING or REFERENCE_NOTICE by the text's shape, else BODY."""
    t, out = collapse(x), F.lit("BODY")
    for name in ("REFERENCE_NOTICE", "HEADING", "CAPTION", "NOTE", "UNIT"):
        rule = t.rlike(CLASSES[name]) & ((F.length(t) <= 80) if name in ("HEADING", "REFERENCE_NOTICE") else F.lit(True))
        out = F.when(rule, name).otherwise(out)
    return F.when(t.isNotNull(), out)


def repair_markup(x: Column) -> Column:
    """Control characters dropped; bare ampersands, angle brackets that open no tag and those of prose escaped."""
    for pattern, by in ((CONTROLS, ""), (BARE_AMPERSAND, "&amp;"), (BARE_BRACKET, "&lt;"), (PROSE_TAG, "&lt;$1>")):
        x = F.regexp_replace(x, pattern, by)
    return x
