"""Readers, governed ingest and writers."""
