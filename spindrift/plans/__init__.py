"""The queries of the library over the driver's tables, by name."""

from spindrift.plans import extra, more, prepared, retrieval, signal  # noqa: F401
from spindrift.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
