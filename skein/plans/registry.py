"""Every query of the engine by name, and the SQL that DuckDB checks it with."""

from __future__ import annotations

from skein.plans import corpus, monitoring, relations, speech, vectors  # noqa: F401
from skein.plans.base import ORACLES, QUERIES  # noqa: F401
