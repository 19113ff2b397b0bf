"""Models of one field."""

from .operators import EOF, GWPCA, OPA, POP, ComplexEOF, ComplexEOFRotator, EOFRotator, ExtendedEOF, HilbertEOF, HilbertEOFRotator, SparsePCA

__all__ = ["EOF", "GWPCA", "OPA", "POP", "ComplexEOF", "ComplexEOFRotator", "EOFRotator", "ExtendedEOF", "HilbertEOF", "HilbertEOFRotator", "SparsePCA"]
