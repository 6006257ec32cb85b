"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when the subpackage is present.
"""
