"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``tessera.llm.queries`` holds the
registered queries and their SQL.
"""
