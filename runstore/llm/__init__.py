"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only when it is
present, so the folder can be removed without touching the rest of the library.
"""
