"""Strict reading of numeric table cells, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Whitespace that surrounds cells: ASCII, no-break and ideographic.
BLANKS = " \t\r\n\x0b\x0c 　"
#: A cell of one of these alone says that the value is missing.
DASHES = ("-", "‐", "–", "—")
#: Fixed pattern: sign, digits plain or in groups of three, fraction; then what is left.
_NUMBER = r"(?s)^([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(.*)$"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def parse_numeric_cell(cell: Column) -> Column:
    """struct(value decimal(38,10), unit, is_missing, is_invalid); the three states exclude each other.

    Missing: null, blank or one dash. A number is an optional sign, digits plain or in exact groups of three, an
    optional fraction and a unit without digits. Parentheses around everything make it negative.
    """
    text = strip(cell)
    wrapped = text.startswith("(") & text.endswith(")") & (F.length(text) >= 2)
    body = F.when(wrapped, strip(F.substr(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    missing = F.coalesce((body == "") | body.isin(*DASHES), F.lit(True))
    number = F.regexp_extract(body, _NUMBER, 1)
    rest = strip(F.regexp_extract(body, _NUMBER, 2))
    amount = F.replace(number, F.lit(",")).try_cast("decimal(38,10)")
    invalid = ~missing & ((number == "") | rest.rlike(r"^[+\-.,]|\d") | amount.isNull())
    valid = ~missing & ~invalid
    value = F.when(valid, F.when(wrapped, -F.abs(amount)).otherwise(amount))
    return F.struct(value.alias("value"), F.when(valid & (rest != ""), rest).alias("unit"), missing.alias("is_missing"), invalid.alias("is_invalid"))


#: Fixed patterns: cells that are numbers (with sign, currency, unit and brackets), dates, years and percentages. In the class of
#: signs `+-△` is a range of characters. (?iU): letters of either case, blanks and digits of Unicode.
NUMERIC_CELL = r"(?iU)^\s*[\(\[]?[+-△▲▼]?\s*[₩$€¥]?\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*(?:%|퍼센트|원|천원|백만원|억원|조원|주|개|명|건|톤|kg|g|km|m|㎡)?\s*[\)\]]?\s*\z"
DATE_CELL = (
    r"(?U)^\d{4}[-./]\d{1,2}(?:[-./]\d{1,2})?\z",
    r"(?U)^\d{4}년(?:\s*\d{1,2}월(?:\s*\d{1,2}일)?)?\z",
    r"(?U)^\d{8}\z",
    r"(?U)^\d{4}\s*[Qq][1-4]\z",
)
YEAR_CELL = r"(?U)^(?:19|20|21)\d{2}\z"
PERCENT_CELL = r"(?iU)^[\(\[]?[+-△▲▼]?\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*(?:%|퍼센트)\s*[\)\]]?\z"


def is_numeric_cell(cell: Column) -> Column:
    """A number with an optional bracket, sign or direction mark, currency sign and unit."""
    return F.coalesce(strip(cell).rlike(NUMERIC_CELL), F.lit(False))


def is_date_cell(cell: Column) -> Column:
    """Year and month with or without a day, a year in Korean writing with or without them, eight digits, or a quarter."""
    return F.coalesce(reduce(lambda a, b: a | b, [strip(cell).rlike(p) for p in DATE_CELL]), F.lit(False))


def is_year_cell(cell: Column) -> Column:
    return F.coalesce(strip(cell).rlike(YEAR_CELL), F.lit(False))


def is_percent_cell(cell: Column) -> Column:
    return F.coalesce(strip(cell).rlike(PERCENT_CELL), F.lit(False))


def parse_market_cap(cell: Column) -> Column:
    """Whole number with commas removed; null where it is blank or no number."""
    return F.replace(F.nullif(strip(cell), F.lit("")), F.lit(",")).try_cast("long")
