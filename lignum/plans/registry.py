"""All queries of the engine, with the SQL that each must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "lignum.operators.log",
    "lignum.operators.tree",
    "lignum.operators.workset",
    "lignum.operators.metrics",
    "lignum.operators.sampling",
    "lignum.operators.budget",
    "lignum.operators.mutations",
    "lignum.operators.check",
    "lignum.operators.chains",
    "lignum.operators.transitions",
    "lignum.operators.clocks",
    "lignum.sources.reports",
    "lignum.streaming.changes",
    "lignum.streaming.states",
    "lignum.functions.names",
    "lignum.functions.rules",
    "lignum.operators.listing",
    "lignum.functions.codes",
    "lignum.operators.presentation",
)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(_name)
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
