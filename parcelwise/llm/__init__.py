"""Operators for preparing text corpora: filters, near duplicates, redaction and mixing."""
