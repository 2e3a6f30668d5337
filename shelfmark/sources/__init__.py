"""Readers and writers: citation exports and the unified record table."""
