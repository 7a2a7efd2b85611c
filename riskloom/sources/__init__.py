"""Typed CSV scans and sinks, Parquet stage tables, and the credit table schemas."""
