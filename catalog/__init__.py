"""Registered queries over the test tables, each with its SQL counterpart."""

from catalog import base, cohorts, concentration, decline, quality, targets
from catalog.registry import Entry

_FAMILIES = (base, cohorts, concentration, decline, targets, quality)


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for family in _FAMILIES:
        for name, entry in family.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = entry
    return out
