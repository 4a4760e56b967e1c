"""Readers and writers of the formats an index is kept or delivered in."""
