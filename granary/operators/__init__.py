"""Relational forms of byte-catalog work: search, claims, gaps, matching, naming, checks."""
