"""Operators for preparing language-model training data, each one a Spark job.

Nothing outside this package imports it; ``corvane.llm.queries`` holds the registered queries.
"""
