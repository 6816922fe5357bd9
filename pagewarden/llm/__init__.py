"""Operators for preparing training corpora: ten stand-alone DataFrame operators and their queries.

Nothing outside this subpackage imports it; the query registry adds it when present.
"""
