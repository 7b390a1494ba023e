"""Relational building blocks: typed slots, scans, joins, anti-joins, and materialised tables."""
