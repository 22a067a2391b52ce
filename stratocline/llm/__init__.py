"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage; its queries and their SQL
are registered by ``__spark_entry__.py`` through :mod:`stratocline.llm.registry`.
"""
