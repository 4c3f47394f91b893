"""Corpus governance on Spark: DataFrame operators for preflight, snapshots, provenance and audit."""

__version__ = "0.1.0"
