"""Models of many fields."""

from .operators import MultiCCA as CCA

__all__ = ["CCA"]
