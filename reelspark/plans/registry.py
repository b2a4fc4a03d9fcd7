"""All core queries and their SQL; the optional subpackage adds its own in ``__spark_entry__``."""

from __future__ import annotations

from reelspark.plans import choices, clips, core_problems, pictures, reference

MODULES = [core_problems, reference, choices, clips, pictures]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
