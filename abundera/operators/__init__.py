"""Relational and numerical operators over long (entity, sample, value) tables."""
