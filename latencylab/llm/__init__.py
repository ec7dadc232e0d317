"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage; its queries are in
:mod:`latencylab.llm.queries` and its tests in ``tests/llm``.
"""
