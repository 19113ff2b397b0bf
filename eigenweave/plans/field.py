"""Labelled data: a long table with one column per dim and one per variable.

A field with a single variable corresponds to an array, with several to a dataset; a list of fields is handled block by block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE, RE, IM = "value", "re", "im"


@dataclass(frozen=True)
class Field:
    """`df` with dim columns `dims` and variables: (name, column of the real part, column of the imaginary part or None)."""

    df: DataFrame
    dims: tuple[str, ...]
    variables: tuple[tuple[str, str, str | None], ...]

    @property
    def is_complex(self) -> bool:
        return any(im for _, _, im in self.variables)

    @property
    def is_dataset(self) -> bool:
        return len(self.variables) > 1 or self.variables[0][0] != VALUE

    @classmethod
    def of(cls, df: DataFrame, dims: Sequence[str] | None = None, variables: Sequence[str] | None = None) -> Field:
        """A long table as a field. Without names, `value` (or `re` and `im`) is the variable and all other columns are dims."""
        names = df.columns
        if variables is None:
            if dims is not None:
                found = [c for c in names if c not in dims]
                variables = found if set(found) != {RE, IM} else None
            elif VALUE in names:
                variables = [VALUE]
            if variables is None:
                if RE not in names or IM not in names:
                    raise ValueError(f"no column {VALUE!r}, and no pair {RE!r}, {IM!r}, among {names}: name dims or variables")
                return cls(df, tuple(dims or (c for c in names if c not in (RE, IM))), ((VALUE, RE, IM),))
        dims = tuple(dims) if dims is not None else tuple(c for c in names if c not in variables)
        missing = [c for c in (*dims, *variables) if c not in names]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        if not variables:
            raise ValueError("a field needs a variable")
        return cls(df, dims, tuple((v, v, None) for v in variables))

    def split(self, sample_dims: Sequence[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(sample dims, feature dims); at least one of the former, and a feature dim or several variables."""
        if not sample_dims:
            raise ValueError("need at least one sample dim")
        missing = [d for d in sample_dims if d not in self.dims]
        if missing:
            raise ValueError(f"sample dims {missing} are not among the dims {list(self.dims)}")
        features = tuple(d for d in self.dims if d not in sample_dims)
        if not features and len(self.variables) == 1 and not self.is_dataset:
            raise ValueError("need at least one feature dim")
        return tuple(sample_dims), features

    def long(self) -> DataFrame:
        """Columns `variable`, the dims, `re` and, of a complex field, `im`; NaN is null."""
        clean = lambda c: F.when(F.isnan(c), F.lit(None)).otherwise(c)
        part = lambda c: clean(F.col(c).cast("double")) if c else F.lit(0.0)
        cells = [F.struct(F.lit(v).alias("variable"), part(re).alias(RE), *([part(im).alias(IM)] if self.is_complex else [])) for v, re, im in self.variables]
        if len(cells) == 1:
            return self.df.select(cells[0].getField("variable").alias("variable"), *self.dims, cells[0].getField(RE).alias(RE), *([cells[0].getField(IM).alias(IM)] if self.is_complex else []))
        return self.df.select(*self.dims, F.inline(F.array(*cells))).select("variable", *self.dims, RE, *([IM] if self.is_complex else []))


@dataclass(frozen=True)
class Packed:
    """Samples as rows: key columns and one array of all features. Positions (from 0) are the coordinates of `feature_dim`.

    Nothing is shuffled to make a matrix of it. Every row is a sample of its own, and all arrays have the same length.
    """

    df: DataFrame
    sample_dims: tuple[str, ...]
    array: str
    feature_dim: str = "feature"
    is_complex = False
    is_dataset = False
    variables = ((VALUE, VALUE, None),)

    @property
    def dims(self) -> tuple[str, ...]:
        return (*self.sample_dims, self.feature_dim)

    def rows(self) -> DataFrame:
        return self.df.select(*self.sample_dims, F.col(self.array).cast("array<double>").alias("__c"))


def as_fields(x) -> tuple[list[Field | Packed], bool]:
    """Fields of a DataFrame, a field or a list of these, and whether it was a list."""
    many = isinstance(x, list | tuple)
    out = []
    for item in x if many else [x]:
        if isinstance(item, Field | Packed):
            out.append(item)
        elif isinstance(item, DataFrame):
            out.append(Field.of(item))
        else:
            raise TypeError(f"need DataFrames or fields, not {type(item).__name__}")
    if not out:
        raise ValueError("an empty list holds no data")
    return out, many


def as_dims(dim) -> tuple[str, ...]:
    dims = (dim,) if isinstance(dim, str) else tuple(dim) if isinstance(dim, list | tuple) else None
    if not dims or not all(isinstance(d, str) for d in dims):
        raise TypeError("dims are a name or a list of names")
    return dims


def same(left: Column, right: Column) -> Column:
    """Equality of coordinates: a null coordinate equals itself."""
    return left.eqNullSafe(right)
