"""Stored indexes: vectors and postings."""
