"""How certain a model is."""

from .operators import EOFBootstrapper

__all__ = ["EOFBootstrapper"]
