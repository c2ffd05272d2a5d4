"""Readers: typed tables, and files of JSON, JSONL, CSV or Parquet records."""
