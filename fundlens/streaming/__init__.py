"""Streaming: incremental, exactly-once landing of daily report files."""

from fundlens.streaming.landing import land_reports, read_store

__all__ = ["land_reports", "read_store"]
