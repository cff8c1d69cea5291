"""Operators for building and cleaning training corpora.

Nothing else in the library imports this subpackage; ``queries`` registers its
contract queries and ``oracles`` their DuckDB twins.
"""
