"""Operators over the canonical tables: retrieval, federation, corpora, curation, checks, reports."""
