"""Registered queries: importing this module imports every query module,
which fills ``QUERIES`` (name -> callable) and ``SQL`` (name -> oracle SQL)."""

from fundlens.plans.catalog import QUERIES, SQL, register, round_doubles  # noqa: F401
from fundlens.plans import queries_core  # noqa: E402,F401
from fundlens.plans import queries_ops  # noqa: E402,F401
from fundlens.plans import queries_stats  # noqa: E402,F401
from fundlens.plans import queries_ml  # noqa: E402,F401
