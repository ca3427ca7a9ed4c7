"""Imports every query module, so that the registry is complete."""

from eventlake.plans import q_correlate, q_detect, q_envelope, q_robust, q_sql, q_store, q_stream, q_triage  # noqa: F401
from eventlake.plans.registry import ORACLES, QUERIES  # noqa: F401
