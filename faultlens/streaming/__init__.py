"""Incremental triage over file streams."""
