"""Structured Streaming variants of the additive roll-ups."""
