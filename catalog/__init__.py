"""Registered queries over the driver tables, each with the DuckDB SQL that must agree."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import inventory, scan, reading, deps, history, risk, changes, audit, calls, plugins, sources  # noqa: F401,E402
