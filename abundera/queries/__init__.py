"""Registered queries and their SQL equivalents, one module per operator family."""
