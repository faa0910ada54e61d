"""Operators over samples, targets, edits, chunks and matches."""
