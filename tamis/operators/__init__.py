"""Detectors and relational operators over datasets."""
