"""Every registered query of the sharpness operators, with its SQL."""

from __future__ import annotations

from acutance.plans import batch, curves, finding, optics, rasters, reporting, shapes  # noqa: F401
from acutance.plans.registry import oracle_sql, queries  # noqa: F401
