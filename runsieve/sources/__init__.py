"""Schemas, readers, writers and staged intermediate tables."""
