"""Readers and writers: annotated blocks, JSON, parallel text."""
