"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it.  Queries and their SQL are in
``queries.py``; each operator has a module of its own.
"""
