"""Requirement catalogues on Spark: reading, parsing, evaluating and checking them as DataFrame jobs."""
