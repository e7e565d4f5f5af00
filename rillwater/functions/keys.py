"""Station keys and text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwater.config import BASIN_PREFIXES, OTHER_BASIN


def clean_key(col: Column) -> Column:
    return F.upper(F.trim(col))


def basin_of(station: Column, rules: Sequence[tuple[str, str]] = BASIN_PREFIXES,
             default: str = OTHER_BASIN) -> Column:
    """Basin by the first prefix rule that fits, in the order given."""
    key = clean_key(station)
    chain = None
    for prefix, basin in rules:
        hit = key.startswith(prefix)
        chain = F.when(hit, basin) if chain is None else chain.when(hit, basin)
    return F.lit(default) if chain is None else chain.otherwise(default)


def first_contained(text: Column, needles: Sequence[str]) -> Column:
    """First of ``needles`` that occurs in the text, null if none does."""
    chain = None
    for needle in needles:
        hit = text.contains(needle)
        chain = F.when(hit, needle) if chain is None else chain.when(hit, needle)
    return F.lit(None).cast("string") if chain is None else chain
