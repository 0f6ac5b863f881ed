"""Readers of sequencing files, and adapters of tables."""
