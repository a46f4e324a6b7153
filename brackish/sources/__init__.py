"""Readers of landed files and idempotent sinks."""
