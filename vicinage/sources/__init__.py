"""Readers of stored feed payloads and pages, tables, and snapshot sinks."""
