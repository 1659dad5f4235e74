"""Catalog enrichment and corpus preparation as Spark DataFrame jobs."""
