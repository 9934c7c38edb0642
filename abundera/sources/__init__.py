"""Readers, format adapters and sinks."""
