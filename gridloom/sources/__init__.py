"""Readers and writers: array files, size listings, job logs, result tables."""
