"""Eigen-methods of one field, of two and of many, their rotations and their validation."""

from .bootstrap import EOFBootstrapper
from .cross import CCA, CPCCA, MCA, RDA, ComplexCCA, ComplexCPCCA, ComplexMCA, ComplexRDA, HilbertCCA, HilbertCPCCA, HilbertMCA, HilbertRDA
from .cross_rotator import ComplexCPCCARotator, ComplexMCARotator, CPCCARotator, HilbertCPCCARotator, HilbertMCARotator, MCARotator
from .extended import OPA, POP, ExtendedEOF
from .gwpca import GWPCA
from .multi import MultiCCA
from .rotator import ComplexEOFRotator, EOFRotator, HilbertEOFRotator, RotatorFactory
from .single import EOF, ComplexEOF, HilbertEOF
from .sparse import SparsePCA

__all__ = [
    "CCA", "CPCCA", "EOF", "GWPCA", "MCA", "OPA", "POP", "RDA",
    "CPCCARotator", "ComplexCCA", "ComplexCPCCA", "ComplexCPCCARotator", "ComplexEOF", "ComplexEOFRotator", "ComplexMCA", "ComplexMCARotator", "ComplexRDA",
    "EOFBootstrapper", "EOFRotator", "ExtendedEOF", "HilbertCCA", "HilbertCPCCA", "HilbertCPCCARotator", "HilbertEOF", "HilbertEOFRotator", "HilbertMCA", "HilbertMCARotator", "HilbertRDA",
    "MCARotator", "MultiCCA", "RotatorFactory", "SparsePCA",
]
