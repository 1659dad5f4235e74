"""Operators for preparing training data: deduplication, filters, scans, extraction and mixing."""
