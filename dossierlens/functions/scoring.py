"""Column arithmetic of the TF-IDF similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(df: Column, n_docs: Column | int) -> Column:
    """``ln(N / (df + 1)) + 1``."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log(n / (df + 1)) + 1.0


def length_norm(n_terms: Column) -> Column:
    """``1 / sqrt(length)``."""
    return 1.0 / F.sqrt(n_terms.cast("double"))


def byte_length_norm(n_terms: Column) -> Column:
    """``1 / sqrt(length)`` cut to two mantissa bits, as a one-byte norm keeps it.

    The exponent ``floor(log2(1 / sqrt(n)))`` is taken from the bit length of ``n - 1``,
    which is exact where a floating-point logarithm may miss a power of two.
    """
    bits = F.when(n_terms > 1, F.length(F.bin(n_terms - 1))).otherwise(0)
    exponent = -F.ceil(bits / 2)
    return F.floor(length_norm(n_terms) * F.pow(F.lit(2.0), 2 - exponent)) / F.pow(
        F.lit(2.0), 2 - exponent
    )


NORMS = {"exact": length_norm, "byte": byte_length_norm}


def rank_value(score: Column) -> Column:
    """The score as ranked: 32-bit, so that the order in which a sum was taken cannot
    swap two equal scores. Ties then fall to the name."""
    return score.cast("float")
