"""Whole evaluations, and the derivation of evaluation tables from the test data."""
