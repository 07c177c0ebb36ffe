"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_NAMES = ["lookalikes", "canonical", "mailtext", "names", "pii", "revisions", "scans", "packing", "mixing"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _NAMES:
    _m = importlib.import_module(f"regispark.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= getattr(_m, "ORACLES", {})
