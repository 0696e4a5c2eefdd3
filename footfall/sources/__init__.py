"""Stored tables and landed request files."""
