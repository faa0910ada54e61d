"""Corrigenda: evaluation of text corrections as Spark jobs."""
