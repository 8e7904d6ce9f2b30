"""Readers: records, tables, trees, strict delimited rows."""
