"""Every query of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from .plans import evaluation, forecasting, preparation

QUERIES = preparation.QUERIES | evaluation.QUERIES | forecasting.QUERIES
ORACLES = preparation.ORACLES | evaluation.ORACLES | forecasting.ORACLES
FLAGSHIP = "daily_baseline"
