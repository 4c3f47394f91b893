"""Composite jobs: what callers run."""
