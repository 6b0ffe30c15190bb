"""All registered queries of the engine's own operators."""

from __future__ import annotations

from . import aggregates, changes, dialect, joins, ordering, relational, scalars, windows
from .registry import Query

FAMILIES = (relational, joins, aggregates, windows, ordering, scalars, changes, dialect)


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in FAMILIES:
        clash = out.keys() & module.FAMILY.queries.keys()
        if clash:
            raise ValueError(f"queries named twice: {sorted(clash)}")
        out |= module.FAMILY.queries
    return out
