"""All queries: importing the modules registers them."""

from discloom.plans import filings, intake, markup, numbers, records, relations, searches, texts  # noqa: F401
from discloom.plans.registry import ORACLES, QUERIES  # noqa: F401
