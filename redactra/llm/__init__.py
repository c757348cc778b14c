"""Operators that prepare training corpora: scoring, filtering, joining, packing and storage.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
