"""Readers, writers, schemas and adapters."""
