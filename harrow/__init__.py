"""Harrow: document-enrichment analytics expressed as PySpark plans."""
