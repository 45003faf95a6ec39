"""Readers, writers and file audits."""
