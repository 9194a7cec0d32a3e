"""Sources and sinks: landed-file scans, typing, and driver-table stand-ins."""

from fundlens.sources import adapter, landed

__all__ = ["adapter", "landed"]
