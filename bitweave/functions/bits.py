"""Integer and bit expressions. All work on BIGINT; right shifts round down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big(value) -> Column:
    return F.lit(value).cast("bigint")


def shr(x: Column, n) -> Column:
    """Floor shift to the right by a number or a column."""
    return F.shiftright(x, n) if isinstance(n, int) else F.call_function("shiftright", x, n.cast("int"))


def pow2(n: Column) -> Column:
    return F.call_function("shiftleft", big(1), n.cast("int"))


def bit_width(x: Column) -> Column:
    """Bits of a number from 0 on; 0 has none."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x))).cast("int")


def sign_folded(x: Column) -> Column:
    """x or its complement, whichever isn't negative; bit_or of it gives a signed depth."""
    return F.when(x < 0, F.bitwise_not(x)).otherwise(x)


def signed_depth(accumulated: Column) -> Column:
    """Bits of two's complement that hold all numbers whose folded bits were accumulated."""
    return (bit_width(accumulated) + 1).cast("int")


def magnitude(x: Column) -> Column:
    return F.abs(x)


def sign_extend(x: Column, bits: Column) -> Column:
    """The low bits of x as a two's complement number."""
    return F.when(x >= pow2(bits - 1), x - pow2(bits)).otherwise(x)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def keep_if(x: Column, condition: Column) -> Column:
    """x where the condition holds, else 0."""
    return F.when(condition, x).otherwise(big(0))


def negate_if(x: Column, condition: Column) -> Column:
    return F.when(condition, -x).otherwise(x)


def pick(x: Column, y: Column, condition: Column) -> Column:
    """y where the condition holds, else x."""
    return F.when(condition, y).otherwise(x)


def bits_of(x: Column, n: Column | int) -> Column:
    """The low n bits of x, most significant first, as a string; none for n = 0."""
    n = F.lit(n) if isinstance(n, int) else n
    raw = F.when(x < 0, F.bin(x)).otherwise(F.lpad(F.bin(x), 64, "0"))
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(raw, (65 - n).cast("int"), n.cast("int")))


def folded_difference(value: Column, previous: Column, low: Column, high: Column) -> Column:
    """The difference to the previous value, as a number from 0 on.

    Within the smaller distance of the previous value to the range's ends both
    signs are possible and alternate; beyond it only one is. Values of the
    range go one to one to the numbers from 0 on.
    """
    d = value - previous
    theta = F.least(previous - low, high - previous)
    return F.when((d >= 0) & (d <= theta), d * 2).when((d < 0) & (-d <= theta), -d * 2 - 1).otherwise(theta + F.abs(d))
