"""Quern: evidence retrieval, provenance analytics and corpus preparation on Spark."""
