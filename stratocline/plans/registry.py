"""All queries of the downscaling engine, and their SQL."""

from __future__ import annotations

from stratocline.plans import models, reports  # noqa: F401  (register their queries)
from stratocline.plans.basic import ORACLE_SQL, QUERIES

FLAGSHIP = "q_metrics_mb_mae_kge"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
