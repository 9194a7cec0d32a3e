"""Operators of a training-data pipeline (language ID, packing, chat
formatting, BPE, deduplication, search, URL rules).

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` derives the registered
``opN_*`` queries from them.
"""
