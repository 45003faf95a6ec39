"""Governed portfolio analytics expressed as Spark DataFrame jobs."""
