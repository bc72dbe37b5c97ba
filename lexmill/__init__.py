"""Spark jobs that build, search, judge and measure text corpora."""
