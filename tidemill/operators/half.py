"""Half-precision numbers (binary16) in a column of two bytes, by arithmetic on doubles.

A double is rounded once, to the nearest half, ties to even; subnormals and infinities are those of the format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: bits of the fraction, the exponent's bias, least normal exponent, bits of infinity and not-a-number, sign.
FRACTION, BIAS, LEAST, INFINITY, NAN, SIGN = 10, 15, -14, 0x7C00, 0x7E00, 0x8000
#: The first double that rounds to infinity.
OVER = 65_520.0


def to_bits(x: Column) -> Column:
    """The half's bits as a smallint (negative numbers have the sign bit); NULL stays NULL."""
    x = x.cast("double")
    a = F.abs(x)
    guess = F.floor(F.log2(F.when((a > 0) & (a < OVER), a).otherwise(1.0))).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # The logarithm is rounded: next to a power of two it can be one off.
    exponent = guess + F.when(a >= two(guess + 1), 1).otherwise(0) - F.when(a < two(guess), 1).otherwise(0)
    exponent = F.when(a > 0, F.greatest(exponent, F.lit(LEAST))).otherwise(LEAST)
    # A power of two scales exactly, and rint rounds ties to even; a fraction that rounds up to the next power carries into the exponent.
    units = F.rint(a / two(exponent - FRACTION)).cast("int")
    size = F.when(F.isnan(x), NAN).when(a >= OVER, INFINITY).otherwise((exponent + BIAS) * (1 << FRACTION) + units - (1 << FRACTION))
    negative = (x < 0) | ((x == 0) & x.cast("string").startswith("-"))
    return F.when(x.isNotNull(), (size - F.when(negative & ~F.isnan(x), SIGN).otherwise(0)).cast("smallint"))


def from_bits(bits: Column) -> Column:
    """The double that a half stands for."""
    b = bits.cast("int")
    size = b.bitwiseAND(F.lit(0x7FFF))
    exponent, units = F.shiftright(size, FRACTION), size.bitwiseAND(F.lit((1 << FRACTION) - 1))
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    value = F.when(exponent == 0, units * two(F.lit(LEAST - FRACTION))).when(exponent < 31, (units + (1 << FRACTION)) * two(exponent - BIAS - FRACTION))
    value = F.when(size > INFINITY, F.lit(float("nan"))).when(size == INFINITY, F.lit(float("inf"))).otherwise(value)
    return F.when(b < 0, -value).otherwise(value)
