"""Audited, versioned key-value histories as Spark jobs."""
