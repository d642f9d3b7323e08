"""Every query of the engine by name, with the SQL that states the same rows where SQL can."""

from __future__ import annotations

import chainloom.plans.files  # noqa: F401  registers its queries
from chainloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
