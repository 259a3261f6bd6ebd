"""Readers and writers: bundles of Markdown files, corpora, append-only logs."""
