"""Declarative pipelines and the operator registry."""
