"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the query registry at the
repository top adds its queries when it is present.
"""
