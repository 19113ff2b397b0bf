"""Models of two fields."""

from .operators import (
    CCA,
    CPCCA,
    MCA,
    RDA,
    ComplexCCA,
    ComplexCPCCA,
    ComplexCPCCARotator,
    ComplexMCA,
    ComplexMCARotator,
    ComplexRDA,
    CPCCARotator,
    HilbertCCA,
    HilbertCPCCA,
    HilbertCPCCARotator,
    HilbertMCA,
    HilbertMCARotator,
    HilbertRDA,
    MCARotator,
)

__all__ = ["CCA", "CPCCA", "MCA", "RDA", "ComplexCCA", "ComplexCPCCA", "ComplexCPCCARotator", "ComplexMCA", "ComplexMCARotator", "ComplexRDA", "CPCCARotator", "HilbertCCA", "HilbertCPCCA", "HilbertCPCCARotator", "HilbertMCA", "HilbertMCARotator", "HilbertRDA", "MCARotator"]
