"""Plan objects of a question: scopes, filters, limits and the checks that come before any data is read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

LEVELS = ("GLOBAL", "COMPANY", "DISCLOSURE", "SECTION")
#: Results asked for at each level, the extra ones of comparing questions, and the most after expansion.
LIMITS = {"SECTION": 3, "DISCLOSURE": 5, "COMPANY": 8, "GLOBAL": 10}
EXTRA, MOST, MORE = 5, 20, {"COMPARISON", "TREND", "HISTORY"}


class PlanError(ValueError):
    """A plan that must not run."""


@dataclass(frozen=True)
class Filter:
    """An exact match or any of several; ranges are refused."""

    key: str
    match: object = None
    any_of: tuple = ()
    bounds: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.bounds:
            raise PlanError(f"{self.key}: no field allows a range")
        if (self.match is None) == (not self.any_of):
            raise PlanError(f"{self.key}: exactly one of match and any_of")

    @property
    def values(self) -> tuple:
        return self.any_of or (self.match,)

    def predicate(self) -> Column:
        return F.col(self.key) == F.lit(self.match) if not self.any_of else F.col(self.key).isin(*self.any_of)


def merged(filters: Iterable[Filter], id_fields: Iterable[str] = ()) -> list[Filter]:
    """Filters on one id field become one any-of; other repeats are refused."""
    out: dict[str, Filter] = {}
    for f in filters:
        if f.key not in out:
            out[f.key] = f
        elif f.key in set(id_fields):
            out[f.key] = Filter(f.key, any_of=tuple(dict.fromkeys((*out[f.key].values, *f.values))))
        else:
            raise PlanError(f"{f.key} is filtered twice")
    return list(out.values())


def conjunction(filters: Iterable[Filter], id_fields: Iterable[str] = ()) -> Column:
    return reduce(lambda a, b: a & b, [f.predicate() for f in merged(filters, id_fields)], F.lit(True))


def signature(filters: Iterable[Filter]) -> tuple[str, ...]:
    """The same for filters and values in any order."""
    return tuple(sorted(f"{f.key}={sorted(map(repr, f.values))}" for f in filters))


@dataclass(frozen=True)
class Scope:
    """Where a question looks: everywhere, or at the companies, disclosures or sections named."""

    level: str
    ids: tuple = ()

    def __post_init__(self) -> None:
        if self.level not in LEVELS:
            raise PlanError(f"unknown level {self.level}")
        if (self.level == "GLOBAL") != (not self.ids):
            raise PlanError("ids are named at every level but GLOBAL")

    def predicate(self, fields: Mapping[str, str]) -> Column:
        return F.lit(True) if self.level == "GLOBAL" else F.col(fields[self.level]).isin(*self.ids)


def latest_only(predicate: Column | None = None, flag: str = "is_latest_version") -> Column:
    """The filter that every read of disclosures has."""
    return F.col(flag) if predicate is None else F.col(flag) & predicate


def result_limit(level: str, intents: Iterable[str] = (), previous: Iterable[int] = (), expand: bool = False, ids: int = 0) -> int:
    """How many results to ask for: one for each id where ids are filtered, more on expansion, MOST at most."""
    if ids:
        return ids
    if expand and (earlier := list(previous)):
        return min(MOST, max(earlier) + EXTRA)
    return LIMITS[level] + (EXTRA if MORE & set(intents) else 0)


def check_clear(intents: Iterable[str], issuers: Iterable[str], periods: Iterable[str]) -> None:
    """A question for an amount must name an issuer and a period."""
    if "AMOUNT" in set(intents) and not (list(issuers) and list(periods)):
        raise PlanError("an amount needs an issuer and a period")


@dataclass(frozen=True)
class Plan:
    """One step: what is asked, of which source, within which scope, after which other steps."""

    plan_id: str
    source: str
    query: str
    scope: Scope
    depends_on: tuple[str, ...] = ()

    def result_id(self, derived: bool = False) -> str:
        return f"{'derived' if derived else 'retrieval'}:{self.plan_id}"


def check_selection(status: str, selected: Iterable[str], results: Mapping[str, str]) -> None:
    """Results chosen at the end: no repeats, known, successful; a COMPLETE answer has at least one."""
    chosen = list(selected)
    if len(set(chosen)) < len(chosen):
        raise PlanError("a result is selected twice")
    if bad := [r for r in chosen if results.get(r) != "SUCCESS"]:
        raise PlanError(f"unknown or failed results: {bad}")
    if status == "COMPLETE" and not chosen:
        raise PlanError("COMPLETE needs a result")
