"""Intermediate tables: ``runstore.sources.scratch``, by this package's name."""

from runstore.sources.scratch import bounded, keep, passing

__all__ = ["bounded", "keep", "passing"]
