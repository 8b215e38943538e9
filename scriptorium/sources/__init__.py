"""Scans, tables, the translation cache and sinks."""
