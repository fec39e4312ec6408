"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Its queries are in
``cubeloom.llm.queries``; ``corpus_pipeline.py`` at the top chains five of
the operators.
"""
