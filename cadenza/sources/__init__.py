"""Readers, writers and the adapter for the shared test tables."""
