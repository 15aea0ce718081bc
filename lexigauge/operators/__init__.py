"""Relational operators: scoring, bootstrap intervals, ranking and stability, reading order."""
