"""Column expressions: text statistics, personal data spans, number text."""
