"""Named queries over the driver tables, each with its SQL check where SQL can state it."""

from __future__ import annotations

import importlib

from rankweave.catalog.base import ORACLE, QUERIES

for _module in ("clicklog", "features", "text", "retrieval", "trainset", "tags", "entities", "evaluation", "io_jobs"):
    importlib.import_module(f"rankweave.catalog.{_module}")

__all__ = ["ORACLE", "QUERIES"]
