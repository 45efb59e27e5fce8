"""Corvane: record analytics, retrieval, usage and text operators expressed as Spark plans."""
