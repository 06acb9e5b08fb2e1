"""Readers and writers of corpora, documents and reports."""
