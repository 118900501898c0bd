"""Operators for preparing training text at scale, one module each, with their
registered queries in ``queries.py``.  Nothing outside this folder, its tests
and ``corpus_pipeline.py`` imports it."""
