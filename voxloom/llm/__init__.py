"""Training-data operators: scans, deduplication, archives, mixing, tokens.

Nothing else in the library imports this subpackage.  Each operator module has
a general interface; ``queries`` binds thin registered queries to them.
"""
