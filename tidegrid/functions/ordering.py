"""Doubles as longs of the same order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEAST_NORMAL = 2.0**-1022
_FRACTION = 52


def ordered_key(value: Column) -> Column:
    """The bits of a double's size as a long, negative for negative numbers: a < b exactly if key(a) < key(b).

    Both zeros are 0. Only exact steps are taken (powers of two, differences of close
    numbers), all in generated code. NULL and NaN have no key.
    """
    size = F.abs(value)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    power = F.pow(F.lit(2.0), guess.cast("double"))
    # a logarithm may round up or down across a power of two
    exponent = guess + F.when(size >= power * 2, 1).when(size < power, -1).otherwise(0)
    fraction = (size / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * F.lit(2.0**_FRACTION)
    normal = F.shiftleft((exponent + 1023).cast("long"), _FRACTION) + fraction.cast("long")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size == F.lit(float("inf")), F.lit(2047 << _FRACTION))
        .when(size < F.lit(_LEAST_NORMAL), tiny)
        .otherwise(normal)
    )
    return F.when(~F.isnan(value), F.when(value < 0, -bits).otherwise(bits))
