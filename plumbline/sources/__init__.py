"""Readers and writers."""

from plumbline.sources.tables import load_tables, read_table

__all__ = ["load_tables", "read_table"]
