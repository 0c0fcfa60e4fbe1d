"""Longitudinal event tables on Spark: tokenisation, decoding, scoring and data preparation."""

__version__ = "0.1.0"
