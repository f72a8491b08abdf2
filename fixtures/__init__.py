"""Inputs derived from the given tables, and the SQL that says what must come out."""
