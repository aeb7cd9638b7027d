"""Operators that prepare training text: detection, encoding, packing, scoring and deduplication.

Nothing outside this subpackage imports it.
"""
