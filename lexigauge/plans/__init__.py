"""Whole evaluations from folders to result files."""
