"""Readers and writers of evaluation folders."""
