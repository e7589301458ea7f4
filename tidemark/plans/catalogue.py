"""Importing this module registers every query."""

import importlib

MODULES = (
    "scans",
    "contracts",
    "series",
    "point_in_time",
    "screening",
    "factors",
    "weighting",
    "ledger",
    "performance",
    "corpus",
    "reconciliation",
    "incremental",
)

for _module in MODULES:
    importlib.import_module(f"tidemark.plans.{_module}")
