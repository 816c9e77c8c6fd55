"""Operators for preparing training corpora (one module each).

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when the package is present.
"""
