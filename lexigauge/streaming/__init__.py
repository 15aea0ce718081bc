"""Incremental scoring of model outputs as they arrive."""
