"""All named queries."""

from quire.plans import analysis, cost, ingest, library, prompts, readability, streaming, textprep, versions  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES  # noqa: F401
