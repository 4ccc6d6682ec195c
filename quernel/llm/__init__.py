"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage.  Each operator lives in
its own module with a general interface; :mod:`quernel.llm.queries` holds the
thin ``opN_<name>`` queries over the standard tables.
"""
