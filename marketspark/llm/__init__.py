"""Operators for building training corpora: filters, deduplication, search, mixing, tokenizing.

Nothing else in the library imports this subpackage.  Each module holds one operator with its
own general interface; ``queries`` registers one production query per operator.
"""
