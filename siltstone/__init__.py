"""Siltstone: content-deduplication analytics expressed as Spark DataFrame programs."""
