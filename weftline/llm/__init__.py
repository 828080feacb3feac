"""Operators for language-model training data: groups of matches, name variants, packing, leaks, languages.

Nothing outside this subpackage imports it.
"""
