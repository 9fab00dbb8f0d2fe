"""Checked queries over the test tables, each with the SQL it must equal."""

import importlib

from checks.base import ORACLES, QUERIES

for _part in ("ingest", "privacy", "judging", "reporting", "streams"):
    importlib.import_module(f"checks.{_part}")

__all__ = ["ORACLES", "QUERIES"]
