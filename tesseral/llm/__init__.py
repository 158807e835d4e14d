"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; each module has one operator with
its general interface, and ``entry`` registers the queries.
"""
