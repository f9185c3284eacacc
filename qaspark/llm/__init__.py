"""Operators for building training corpora: ten of them, one module each.

Nothing outside this folder imports it.  `registry` names the queries.
"""
