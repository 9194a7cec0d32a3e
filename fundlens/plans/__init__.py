"""Composed queries: dashboard/report plans and the query registry."""
