"""Whole results composed of operators, and the query catalogue."""
