"""Whole analyses: every detector over a dataset, metrics, and the report."""
