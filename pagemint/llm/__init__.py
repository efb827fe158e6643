"""Operators for preparing training text: tokenizing, scanning, deduplicating, filtering.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Each module holds one operator with its own
general interface; ``queries`` derives the fixed result columns of the registered ``opN_`` queries from them.
"""
